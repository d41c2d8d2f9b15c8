"""Models and evaluation runs on the derived panels."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.features import staged
from checks.registry import query, r
from checks.statistics import LIFE, life
from checks.tables import training
from checks.views_sql import WEEKLY_PANEL
from ebbtide.config import FEATURE_COLUMNS
from ebbtide.models import survival as MS
from ebbtide.models.validate import (assert_no_owner_leakage, group_folds, grouped_cv, held_out_owner_predictions,
                                     null_outcome)
from ebbtide.operators import features as feat
from ebbtide.operators.concordance import concordance
from ebbtide.operators.tables import model_rows
from ebbtide.plans import evaluate as E
from ebbtide.plans.views import COHORTS, PANEL, table, weekly_panel
from ebbtide.functions import scalars as S

# Small settings: these registered runs show the whole path, not a tuned model. `evaluate` runs in full.
QUICK = replace(PANEL, draws=20, folds=2)
TREES = 5


def rows(spark, sf):
    """A training table: the analysed weekly entities."""
    return E.cut_lineage(E.survival_rows(staged(spark, sf).frame))


def predictors(d):
    return feat.usable_features(d, FEATURE_COLUMNS)


@query("group_folds_dealt", """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, count(*) AS n FROM orders GROUP BY 1),
    i AS (SELECT owner, row_number() OVER (ORDER BY n DESC, owner) - 1 AS i FROM s)
  SELECT owner, CASE WHEN (i // 5) % 2 = 1 THEN 4 - i % 5 ELSE i % 5 END AS fold FROM i""")
def folds_dealt(spark, sf):
    return group_folds(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("owner")), 5)


@query("group_folds", f"WITH {LIFE} SELECT count(DISTINCT owner) AS owners, least(5, count(DISTINCT owner)) AS folds, true AS disjoint FROM life")
def folds(spark, sf):
    d = life(spark, sf)
    f = assert_no_owner_leakage(d.join(group_folds(d, 5), "owner"))
    per = f.groupBy("owner").agg(F.count_distinct("fold").alias("k"), F.max("fold").alias("fold"))
    return per.agg(F.count(F.lit(1)).alias("owners"), F.count_distinct("fold").alias("folds"), (F.max("k") == 1).alias("disjoint"))


@query("km_baseline", f"""WITH {LIFE}, k AS (SELECT duration AS t, sum(event::INT) AS d, count(*) AS c FROM life GROUP BY 1), n AS (SELECT *, sum(c) OVER (ORDER BY t DESC) AS n FROM k),
  s AS (SELECT t, exp(sum(CASE WHEN d < n THEN ln((n - d) / n::DOUBLE) ELSE -1e9 END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS s FROM n),
  m AS (SELECT coalesce(min(t) FILTER (s <= 0.500000000001), max(t)) AS med FROM s) SELECT entity, round(med, 6) AS predicted FROM life, m""")
def km_baseline(spark, sf):
    d = life(spark, sf)
    return MS.KaplanMeierMedian().fit(d).predict(d).select("entity", "predicted")


@query("constant_baseline", f"WITH {LIFE} SELECT entity, 48.0::DOUBLE AS predicted FROM life")
def constant_baseline(spark, sf):
    d = life(spark, sf)
    return MS.ConstantLifetime().fit(d).predict(d).select("entity", "predicted")


@query("person_periods", f"""WITH {LIFE}, g(slot, a, b) AS (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for i, (a, b) in enumerate(zip((0.0, *PANEL.marks), PANEL.marks)))})
  SELECT entity, CAST(slot AS BIGINT) AS slot, b AS mark, CASE WHEN event AND duration <= b THEN 1.0 ELSE 0.0 END::DOUBLE AS ended FROM life, g
  WHERE (a < duration OR slot = 0) AND (event OR b <= duration)""")
def person_periods(spark, sf):
    return MS.person_periods(life(spark, sf), list(PANEL.marks)).select("entity", "slot", "mark", "ended")


@query("weibull_aft")
def weibull_aft(spark, sf):
    d = rows(spark, sf)
    return MS.WeibullAFT(predictors(d)).fit(d).predict(d).select("entity", "duration", "event", "predicted")


@query("owner_size_baseline")
def owner_size(spark, sf):
    d = rows(spark, sf)
    return MS.owner_size_only().fit(d).predict(d).select("entity", "predicted")


@query("loglinear")
def loglinear(spark, sf):
    d = rows(spark, sf)
    return MS.LogLinear(predictors(d)).fit(d).predict(d).select("entity", "predicted")


@query("gradient_boosted")
def gradient_boosted(spark, sf):
    d = rows(spark, sf)
    return MS.GradientBoosted(predictors(d), rounds=10).fit(d).predict(d).select("entity", "predicted")


@query("hazard_forest")
def hazard_forest(spark, sf):
    d = rows(spark, sf)
    m = MS.HazardForest(predictors(d), E.residual_grid(PANEL, PANEL.landmark), trees=TREES).fit(d)
    return m.predict(d).select("entity", "predicted")


@query("grouped_cv")
def cv(spark, sf):
    d = rows(spark, sf)
    f = predictors(d)
    return grouped_cv([MS.ConstantLifetime(), MS.KaplanMeierMedian(), MS.WeibullAFT(f), MS.LogLinear(f)], d, 3).select(
        "model", "fold", "entity", "predicted")


@query("evaluate")
def evaluate(spark, sf):
    """All eight models in full: five folds, 300 trees, 200 rounds, scored with intervals from 2,000 draws."""
    return E.evaluate(staged(spark, sf).frame, PANEL).scores


@query("practical_eval")
def practical_eval(spark, sf):
    readings = weekly_panel(spark, sf)
    d = E.landmark_inputs(staged(spark, sf).frame, readings, PANEL, PANEL.landmark)
    d = d.withColumn("cohort", S.cohort_of("published_at", COHORTS))
    p = E.practical_eval(d.filter("cohort IN ('A', 'B')"), d.filter("cohort NOT IN ('A', 'B')"), QUICK, PANEL.landmark, TREES)
    return p.flag_intervals


@query("held_out_owner_predictions")
def held_out(spark, sf):
    t = E.cut_lineage(model_rows(training(spark, sf), PANEL))
    out = held_out_owner_predictions(t, t, PANEL, b=0.7, trees=5)
    return out.select("entity", "mark", *[c for c in out.columns if c.startswith(("raw_", "p_", "avg_"))])


@query("instant_eval")
def instant_eval(spark, sf):
    t = E.cut_lineage(training(spark, sf))
    cut = t.filter("cohort = 'A'"), model_rows(t.filter("cohort <> 'A'"), PANEL)
    return E.instant_eval(cut[0], cut[1], QUICK, 0.7, 0.5, 0.2, trees=5).by_horizon


@query("null_outcome", f"WITH {WEEKLY_PANEL} SELECT count(DISTINCT entity) AS entities, true AS agrees_within_owner FROM p")
def null_check(spark, sf):
    """The noise outcome is one draw per owner plus one per entity, anywhere it is computed."""
    d = weekly_panel(spark, sf).select("entity", "owner").distinct()
    n = null_outcome(d, PANEL.seed)
    again = null_outcome(d.repartition(5), PANEL.seed)
    same = n.groupBy("owner").agg(F.count_distinct("log_follower_count").alias("k")).agg((F.max("k") == 1).alias("ok"))
    both = n.select("entity", "duration").join(again.select("entity", F.col("duration").alias("d2")), "entity")
    return both.agg(F.count(F.lit(1)).alias("entities"), (F.max(F.abs(F.col("duration") - F.col("d2"))) == 0).alias("eq")).crossJoin(same).select(
        "entities", (F.col("eq") & F.col("ok")).alias("agrees_within_owner"))


@query("null_cohort_leakage")
def null_cohort(spark, sf):
    """A model on the null outcome, owners kept apart: C should lie near one half."""
    d = E.cut_lineage(null_outcome(rows(spark, sf), PANEL.seed))
    p = grouped_cv([MS.LogLinear(["log_follower_count", "log_value_m3"])], d, 3)
    return concordance(p)

"""Survival curves, scores, calibration, agreement, resampling."""

from pyspark.sql import functions as F

from checks.bronze import fresh_folder
from checks.registry import query, r
from checks.views_sql import EVENT_PANEL, WEEKLY_ENTITIES, WEEKLY_PANEL, label_ctes
from ebbtide.operators import metrics as M
from ebbtide.operators import survival as V
from ebbtide.operators.concordance import concordance
from ebbtide.operators.labels import decay_label
from ebbtide.operators.pairs import decided_pairs, early_share_facts, keep_patterns, pair_counts, pair_share
from ebbtide.operators.resample import (bootstrap_ci, concordance_draws, flag_bootstrap, owner_bootstrap,
                                        paired_delta_bootstrap, score_models)
from ebbtide.operators.skew import average_ranks, exact_quantiles
from ebbtide.plans.views import PANEL, event_panel, table, weekly_entities, weekly_panel
from ebbtide.session import cut_lineage
from ebbtide.sources.tables import stack_models, write_predictions

LIFE = f"""{EVENT_PANEL}, {label_ctes()}, life AS (SELECT entity, split_part(entity, '_', 1) AS owner, split_part(entity, '_', 2) AS tier,
  t_death AS duration, event_observed AS event, peak_at_hours + 7.0::DOUBLE * n_intervals AS m1, 500.0::DOUBLE / (1.0::DOUBLE + peak_velocity) AS m2,
  final_value, n_intervals, last_observed_hours FROM lab WHERE exclude_reason IS NULL)"""


def life(spark, sf):
    """One row per labelled entity with two simple predictions."""
    lab = decay_label(event_panel(spark, sf), PANEL, seq="seq").filter(F.col("exclude_reason").isNull())
    parts = F.split("entity", "_")
    return lab.select("entity", parts[0].alias("owner"), parts[1].alias("tier"), F.col("t_death").alias("duration"),
                      F.col("event_observed").alias("event"),
                      (F.col("peak_at_hours") + F.lit(7.0) * F.col("n_intervals")).alias("m1"),
                      (F.lit(500.0) / (1 + F.col("peak_velocity"))).alias("m2"), "final_value", "n_intervals", "last_observed_hours")


def stacked(spark, sf):
    d = life(spark, sf)
    keep = lambda m: d.select("entity", "owner", "duration", "event", F.col(m).alias("predicted"))
    return stack_models({"m1": keep("m1"), "m2": keep("m2")})


STACK = f"""{LIFE}, stk AS (SELECT entity, owner, duration, event, m1 AS predicted, 'm1' AS model FROM life
  UNION ALL SELECT entity, owner, duration, event, m2, 'm2' FROM life)"""


def km_ctes(src: str, by: str = "", time: str = "duration", event: str = "event", out: str = "km") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{out}_t AS (SELECT {k}{time} AS t, sum({event}::INT) AS d, count(*) AS c FROM {src} WHERE {time} IS NOT NULL GROUP BY {k}{time}),
  {out}_r AS (SELECT *, sum(c) OVER ({part}) - coalesce(sum(c) OVER ({part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM {out}_t),
  {out} AS (SELECT {k}t, d AS deaths, n AS at_risk, CASE WHEN max((d = n)::INT) OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) = 1 THEN 0
    ELSE exp(sum(CASE WHEN d < n THEN ln((n - d) / n::DOUBLE) ELSE 0 END) OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING)) END AS s,
    sum(CASE WHEN d < n THEN d / (n::DOUBLE * (n - d)) ELSE 0 END) OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS green FROM {out}_r)"""


@query("kaplan_meier", f"WITH {LIFE}, {km_ctes('life')} SELECT {r('~t, #deaths, #at_risk, ~s')} FROM km")
def kaplan_meier(spark, sf):
    return V.kaplan_meier(life(spark, sf))


@query("kaplan_meier_by_tier", f"""WITH {LIFE}, {km_ctes('life', 'tier')}, z AS (SELECT *, sqrt(green) / ln(s) AS v FROM km WHERE s > 0 AND s < 1)
  SELECT km.tier, round(km.t, 6) AS t, round(km.s, 6) + 0.0 AS s, round(coalesce(least(exp(-exp(ln(-ln(z.s)) - 1.959963984540054 * v)), exp(-exp(ln(-ln(z.s)) + 1.959963984540054 * v))), km.s), 6) + 0.0 AS s_low,
  round(coalesce(greatest(exp(-exp(ln(-ln(z.s)) - 1.959963984540054 * v)), exp(-exp(ln(-ln(z.s)) + 1.959963984540054 * v))), km.s), 6) + 0.0 AS s_high
  FROM km LEFT JOIN z ON z.tier = km.tier AND z.t = km.t""")
def kaplan_meier_by_tier(spark, sf):
    return V.kaplan_meier(life(spark, sf), by=["tier"], band=True).select("tier", "t", "s", "s_low", "s_high")


@query("km_thin", f"""WITH {LIFE}, {km_ctes('life', 'tier')} SELECT tier, round_even(t * 2, 0) / 2 AS t_bin, round(arg_max(s, t), 6) + 0.0 AS s FROM km GROUP BY ALL""")
def km_thin(spark, sf):
    return V.km_thin(V.kaplan_meier(life(spark, sf), by=["tier"]), ["tier"])


@query("km_median", f"""WITH {LIFE}, {km_ctes('life', 'tier')} SELECT tier, round(coalesce(min(t) FILTER (s <= 0.500000000001), max(t)), 6) AS km_median,
  min(s) <= 0.500000000001 AS median_reached FROM km GROUP BY tier""")
def km_median(spark, sf):
    return V.km_median(life(spark, sf), by=["tier"])


@query("logrank_groups", f"""WITH {LIFE}, tm AS (SELECT DISTINCT duration AS t FROM life WHERE event), g AS (SELECT DISTINCT tier FROM life),
  x AS (SELECT g.tier, tm.t, (SELECT count(*) FROM life l WHERE l.tier = g.tier AND l.duration >= tm.t) AS r,
    (SELECT count(*) FROM life l WHERE l.tier = g.tier AND l.duration = tm.t AND l.event) AS d FROM tm, g),
  y AS (SELECT *, sum(r) OVER (PARTITION BY t) AS n, sum(d) OVER (PARTITION BY t) AS dd FROM x)
  SELECT tier AS "group", CAST(sum(d) AS BIGINT) AS observed, round(sum(dd * r / n::DOUBLE), 6) AS expected,
  round(sum(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1)::DOUBLE * (r / n::DOUBLE) * (1 - r / n::DOUBLE) ELSE 0 END), 6) AS variance FROM y GROUP BY tier""")
def logrank_groups(spark, sf):
    return V.logrank_groups(life(spark, sf), group="tier")


@query("logrank_test")
def logrank_test(spark, sf):
    return V.logrank_test(life(spark, sf), group="tier")


@query("tier_table", f"""WITH {LIFE}, l2 AS (SELECT *, owner::INT % 2 AS half FROM life), a AS (SELECT half, tier, duration, event, owner FROM l2
   UNION ALL SELECT half, NULL, duration, event, owner FROM l2 UNION ALL SELECT NULL, NULL, duration, event, owner FROM l2),
  {km_ctes('a', 'half, tier', out='k')}, m AS (SELECT half, tier, coalesce(min(t) FILTER (s <= 0.500000000001), max(t)) AS km_median FROM k GROUP BY half, tier),
  n AS (SELECT half, tier, count(*) AS entities, count(*) FILTER (event) AS events, count(DISTINCT owner) AS owners FROM a GROUP BY half, tier)
  SELECT CAST(n.half AS BIGINT) AS half, n.tier, entities, events, owners, round(km_median, 6) AS km_median FROM n
  JOIN m ON n.half IS NOT DISTINCT FROM m.half AND n.tier IS NOT DISTINCT FROM m.tier""")
def tier_table(spark, sf):
    d = life(spark, sf).withColumn("half", F.col("owner").cast("bigint") % 2)
    return V.tier_table(d, ["half", "tier"])


@query("cohort_counts", f"""WITH {LIFE} SELECT tier, count(*) AS entities, count(*) FILTER (event) AS events, count(DISTINCT owner) AS owners,
  round(avg((NOT event)::INT), 6) AS censored_share FROM life GROUP BY tier""")
def cohort_counts(spark, sf):
    return V.cohort_counts(life(spark, sf), "event", ["tier"])


def pairs_sql(src: str, time: str, event: str, pred: str) -> str:
    return f"""SELECT count(*) AS pairs, count(*) FILTER (b.{pred} > a.{pred}) AS concordant, count(*) FILTER (b.{pred} = a.{pred}) AS tied,
  round((count(*) FILTER (b.{pred} > a.{pred}) + count(*) FILTER (b.{pred} = a.{pred}) / 2.0) / nullif(count(*), 0), 6) AS c_index
  FROM {src} a JOIN {src} b ON a.{event} AND (a.{time} < b.{time} OR (a.{time} = b.{time} AND NOT b.{event}))"""


@query("concordance", f"WITH {LIFE} {pairs_sql('life', 'duration', 'event', 'm1')}")
def concordance_life(spark, sf):
    return concordance(life(spark, sf), predicted="m1")


@query("concordance_by_model", f"WITH {STACK} SELECT a.model, " + pairs_sql("stk", "duration", "event", "predicted")[7:]
       .replace("ON a.event", "ON a.model = b.model AND a.event") + " GROUP BY a.model")
def concordance_by_model(spark, sf):
    return concordance(stacked(spark, sf), by=["model"], buckets=7)


ORDERS = """o AS (SELECT date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS t, o_orderstatus = 'F' AS e,
  floor(o_totalprice / 1000) AS p FROM orders)"""


@query("concordance_cut", f"WITH {ORDERS} {pairs_sql('o', 't', 'e', 'p')}")
def concordance_cut(spark, sf):
    """The same count on a forced grid: blocks, hot values and both kinds of residual."""
    o = table(spark, sf, "orders").select(
        F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("duration"),
        (F.col("o_orderstatus") == "F").alias("event"), F.floor(F.col("o_totalprice") / 1000).alias("predicted"))
    return concordance(o, buckets=12)


@query("log_errors", f"""WITH {STACK} SELECT model, round(avg(abs(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)))), 6) AS mae_log10,
  round(sqrt(avg(pow(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)), 2))), 6) AS rmse_log10, count(*) AS n_events FROM stk WHERE event GROUP BY model""")
def log_errors(spark, sf):
    return M.log_errors(stacked(spark, sf), ["model"])


@query("fold_scores", f"""WITH {STACK} SELECT model, CAST(owner::INT % 5 AS BIGINT) AS fold, round(avg(abs(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)))), 6) AS mae_log10,
  round(sqrt(avg(pow(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)), 2))), 6) AS rmse_log10, count(*) AS n_events FROM stk WHERE event GROUP BY ALL""")
def fold_scores(spark, sf):
    return M.fold_scores(stacked(spark, sf).withColumn("fold", F.col("owner").cast("bigint") % 5))


FLAG = f"{LIFE}, fl AS (SELECT *, duration <= 200 AND event AS fast, m1 <= (SELECT quantile_cont(m1, 0.2) FROM life) AS flagged FROM life)"


def with_fast(spark, sf):
    return life(spark, sf).withColumn("fast", F.col("event") & (F.col("duration") <= 200))


@query("flag_metrics", f"""WITH {FLAG}, s AS (SELECT count(*) AS n, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (fast) AS n_fast,
   count(*) FILTER (flagged AND fast) AS n_hit FROM fl)
  SELECT n, n_flagged, n_fast, n_hit, round(n_hit / n_flagged, 6) AS precision, round(n_fast / n, 6) AS base_rate, round(n_hit / n_fast, 6) AS recall,
  round(n_hit / n_flagged - n_fast / n, 6) AS precision_minus_base, round((n_hit / n_flagged) / (n_fast / n), 6) AS lift FROM s""")
def flag_metrics(spark, sf):
    return M.flag_metrics(with_fast(spark, sf), "m1", "fast", 0.2)


@query("exact_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS q2 FROM lineitem GROUP BY 1""")
def quantiles_cut(spark, sf):
    """Three groups hold the whole table; every one is cut and the ranks found across pieces."""
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.025, 0.5, 0.975], ["l_returnflag"], max_rows=500)
    return q.select("l_returnflag", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])


@query("risk_thresholds", f"WITH {LIFE} SELECT round(quantile_cont(m2, 0.8), 6) AS high, round(quantile_cont(m2, 0.2), 6) AS low FROM life")
def risk_thresholds(spark, sf):
    return M.risk_thresholds(life(spark, sf), "m2")


@query("calibration_deciles", f"""WITH {LIFE}, e AS (SELECT list_sort(list_distinct(quantile_cont(m1, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM life),
  b AS (SELECT m1, event, len(list_filter(e[2:len(e) - 1], lambda x: x < m1)) AS bin FROM life, e)
  SELECT CAST(bin AS BIGINT) AS bin, round(avg(m1), 6) AS predicted, round(avg(event::INT), 6) AS observed, count(*) AS n FROM b GROUP BY bin""")
def calibration_deciles(spark, sf):
    return M.calibration_deciles(life(spark, sf), "m1", "event")


RANKED = f"""{LIFE}, rb AS (SELECT *, CAST(greatest(ceil((row_number() OVER (ORDER BY m1, entity) - 1) * 10 / (count(*) OVER () - 1)::DOUBLE) - 1, 0) AS BIGINT) AS bin FROM life)"""


@query("rank_bins", f"WITH {RANKED} SELECT entity, bin FROM rb")
def rank_bins(spark, sf):
    return M.rank_bins(life(spark, sf), "m1", max_rows=40).select("entity", "bin")


@query("calibration_km", f"""WITH {RANKED}, {km_ctes('rb', 'bin')}, m AS (SELECT bin, min(t) FILTER (s <= 0.500000000001) AS km_median FROM km GROUP BY bin)
  SELECT bin, round(median(m1), 6) AS predicted_median, round(m.km_median, 6) AS km_median FROM rb JOIN m USING (bin) GROUP BY bin, m.km_median""")
def calibration_km(spark, sf):
    return M.calibration_km(life(spark, sf).withColumnRenamed("m1", "predicted"))


@query("average_ranks", """SELECT DISTINCT round(l_quantity, 6) AS l_quantity, round(avg(rn) OVER (PARTITION BY l_quantity), 6) AS rank
  FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS rn FROM lineitem)""")
def ranks(spark, sf):
    return average_ranks(table(spark, sf, "lineitem"), "l_quantity", "rank", max_rows=10)


@query("spearman", """WITH a AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
    rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem)
  SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM a""")
def spearman(spark, sf):
    return M.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount")


@query("label_agreement", f"""WITH {LIFE}, d AS (SELECT *, CASE WHEN n_intervals % 5 <> 0 THEN m1 - 60 END AS sat FROM life),
  c AS (SELECT duration AS t, sat FROM d WHERE sat IS NOT NULL AND event),
  k AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS x, rank() OVER (ORDER BY sat) + (count(*) OVER (PARTITION BY sat) - 1) / 2.0 AS y FROM c)
  SELECT (SELECT count(*) FROM d) AS n_entities, (SELECT count(sat) FROM d) AS fitted, (SELECT round(avg((sat IS NOT NULL)::INT), 6) FROM d) AS coverage,
  (SELECT count(*) FILTER (sat < 0) FROM d) AS before_landmark, (SELECT count(*) FILTER (sat > last_observed_hours) FROM d) AS beyond_window,
  (SELECT round(avg((sat < 0)::INT), 6) FROM d WHERE sat IS NOT NULL) AS share_before_landmark, (SELECT count(*) < 20 FROM c) AS underpowered,
  (SELECT count(*) FROM c) AS n_comparable, (SELECT round(corr(x, y), 6) FROM k) AS spearman_rho,
  (WITH a AS (SELECT abs(corr(x, y)) AS r, (count(*) - 2) / 2.0 AS h FROM k),
     u AS (SELECT r, h, i, r + (1 - r) * i / 4000.0 AS u FROM a, (SELECT unnest(generate_series(0, 4000)) AS i))
   SELECT round(2 * exp(lgamma(any_value(h) + 0.5) - lgamma(any_value(h)) - lgamma(0.5)) * (1 - any_value(r)) / 12000.0
     * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 - u * u, h - 1)), 6) + 0.0 FROM u) AS spearman_p,
  round(quantile_cont(sat / t, 0.5), 6) AS median_ratio, round(quantile_cont(sat / t, 0.25), 6) AS ratio_q25, round(quantile_cont(sat / t, 0.75), 6) AS ratio_q75
  FROM c WHERE t > 0""")
def label_agreement(spark, sf):
    d = life(spark, sf).withColumn("t_saturation", F.when(F.col("n_intervals") % 5 != 0, F.col("m1") - 60))
    d = d.withColumn("saturation_beyond_window", F.coalesce(F.col("t_saturation") > F.col("last_observed_hours"), F.lit(False)))
    return M.label_agreement(d, "duration", "t_saturation", "event")


@query("signed_rank_sums", f"""WITH {LIFE}, d AS (SELECT abs(log10(duration) - log10(m1)) - abs(log10(duration) - log10(m2)) AS d FROM life WHERE event AND m1 > 0 AND m2 > 0 AND duration > 0),
  k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0)
  SELECT (SELECT count(*) FROM d) AS n_pairs, round(sum(rk) FILTER (d > 0), 6) AS w_plus, round(sum(rk) FILTER (d < 0), 6) AS w_minus, count(*) AS n_nonzero,
  (SELECT round(median(d), 6) FROM d) AS median_diff FROM k""")
def signed_rank_sums(spark, sf):
    s = stacked(spark, sf)
    return M.signed_rank_sums(s.filter("model = 'm1'"), s.filter("model = 'm2'")).drop("ties", "largest")


@query("wilcoxon_signed_rank")
def wilcoxon_signed_rank(spark, sf):
    s = stacked(spark, sf)
    return M.wilcoxon_signed_rank(s.filter("model = 'm1'"), s.filter("model = 'm2'"))


@query("owner_bootstrap")
def owner_boot(spark, sf):
    d = M.flagged(with_fast(spark, sf), "m1")
    return flag_bootstrap(d, "fast", PANEL.draws, PANEL.seed)


@query("owner_bootstrap_total")
def owner_boot_total(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("owner"), "l_extendedprice", "l_discount")
    return owner_bootstrap(li, {"gross": F.col("l_extendedprice"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))},
                           lambda: {"net_share": F.col("net") / F.col("gross")}, PANEL.draws, PANEL.seed)


@query("bootstrap_ci")
def boot_ci(spark, sf):
    s = cut_lineage(stacked(spark, sf))
    return bootstrap_ci(score_models(s), concordance_draws(s, PANEL.draws, PANEL.seed))


@query("paired_delta_bootstrap")
def paired(spark, sf):
    s = cut_lineage(stacked(spark, sf))
    return paired_delta_bootstrap(score_models(s), cut_lineage(concordance_draws(s, PANEL.draws, PANEL.seed)), [("m1", "m2")])


def inside(point: str, low: str, high: str):
    return F.coalesce((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high)), F.lit(False))


@query("owner_bootstrap_point", """SELECT 'net_share' AS name, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS point, true AS inside
  FROM lineitem""")
def owner_boot_point(spark, sf):
    """The estimate, which is exact, and whether its interval holds it."""
    return owner_boot_total(spark, sf).select("name", "point", inside("point", "low", "high").alias("inside"))


SCORES = pairs_sql("stk", "duration", "event", "predicted")[7:].replace("ON a.event", "ON a.model = b.model AND a.event")
MAE = """m AS (SELECT model, avg(abs(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)))) AS mae FROM stk WHERE event GROUP BY model)"""


@query("bootstrap_ci_point", f"""WITH {STACK}, {MAE}, c AS (SELECT a.model, {SCORES} GROUP BY a.model)
  SELECT model, c_index, round(mae, 6) AS mae_log10, true AS c_inside, true AS mae_inside FROM c JOIN m USING (model)""")
def boot_ci_point(spark, sf):
    d = boot_ci(spark, sf)
    return d.select("model", "c_index", "mae_log10", inside("c_index", "c_low", "c_high").alias("c_inside"), inside("mae_log10", "mae_low", "mae_high").alias("mae_inside"))


@query("paired_delta_point", f"""WITH {STACK}, {MAE}, c AS (SELECT a.model, {SCORES} GROUP BY a.model), s AS (SELECT * FROM c JOIN m USING (model))
  SELECT 'm1' AS model, 'm2' AS baseline, {PANEL.draws} AS draws, round(x.mae - y.mae, 6) AS delta_mae_log10, true AS inside
  FROM s x, s y WHERE x.model = 'm1' AND y.model = 'm2'""")
def paired_point(spark, sf):
    d = paired(spark, sf)
    return d.select("model", "baseline", "draws", "delta_mae_log10", inside("delta_c_index", "delta_c_low", "delta_c_high").alias("inside"))


MARK_CASE = "CASE " + " ".join(f"WHEN {m!r}::DOUBLE <= duration + {PANEL.tolerance} THEN {m!r}::DOUBLE" for m in reversed(PANEL.marks)) + f" ELSE {PANEL.marks[0]!r}::DOUBLE END"
FADED = f"{LIFE}, fd AS (SELECT entity, owner, tier, {MARK_CASE} AS fade_h, event AS faded, round(m1, 0) AS factor, owner::INT % 2 AS half FROM life)"


def faded(spark, sf):
    from ebbtide.functions.scalars import fade_mark
    return life(spark, sf).select("entity", "owner", "tier", fade_mark("duration", PANEL).alias("fade_h"),
                                  F.col("event").alias("faded"), F.round("m1", 0).alias("factor"),
                                  (F.col("owner").cast("bigint") % 2).alias("half"))


@query("average_curve", f"""WITH {FADED}, m(ord, mark) AS (VALUES {', '.join(f'({i}, {m!r}::DOUBLE)' for i, m in enumerate(PANEL.marks))}),
  x AS (SELECT ord, mark, count(*) FILTER (fade_h >= mark) AS n, count(*) FILTER (fade_h = mark AND faded) AS d FROM m, fd GROUP BY ord, mark)
  SELECT CAST(ord AS BIGINT) AS ord, round(product(CASE WHEN n > 0 THEN 1 - d / n::DOUBLE ELSE 1 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS s FROM x""")
def average_curve(spark, sf):
    return V.average_curve(faded(spark, sf), PANEL).select(F.posexplode("average").alias("ord", "s"))


@query("pair_counts", f"""WITH {FADED} SELECT a.owner, round(CAST(sum(CASE WHEN b.factor > a.factor THEN 1.0 WHEN b.factor = a.factor THEN 0.5 ELSE 0 END) AS DOUBLE), 6) AS score, count(*) AS pairs
  FROM fd a JOIN fd b ON a.owner = b.owner AND a.fade_h < b.fade_h AND a.faded GROUP BY a.owner""")
def owner_pairs(spark, sf):
    return pair_counts(faded(spark, sf), "factor", cfg=PANEL)


@query("pair_share", f"""WITH {FADED}, pc AS (SELECT a.half, a.owner, sum(CASE WHEN b.factor > a.factor THEN 1.0 WHEN b.factor = a.factor THEN 0.5 ELSE 0 END) AS score, count(*) AS pairs
  FROM fd a JOIN fd b ON a.owner = b.owner AND a.fade_h < b.fade_h AND a.faded GROUP BY ALL)
  SELECT CAST(half AS BIGINT) AS half, round(sum(score) / sum(pairs), 6) AS share, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS owners FROM pc GROUP BY half""")
def owner_pair_share(spark, sf):
    return pair_share(faded(spark, sf), "factor", ["half"], PANEL)


@query("pair_counts_hot_owner", f"""WITH {FADED} SELECT a.tier AS owner, round(CAST(sum(CASE WHEN b.factor > a.factor THEN 1.0 WHEN b.factor = a.factor THEN 0.5 ELSE 0 END) AS DOUBLE), 6) AS score, count(*) AS pairs
  FROM fd a JOIN fd b ON a.tier = b.tier AND a.fade_h < b.fade_h AND a.faded GROUP BY a.tier""")
def hot_owner_pairs(spark, sf):
    """Five owners hold everything, and every one is cut along the factor."""
    return pair_counts(faded(spark, sf).withColumn("owner", F.col("tier")), "factor", cfg=PANEL, max_rows=20)


@query("keep_patterns", f"""WITH {FADED}, s AS (SELECT tier AS factor, CASE WHEN half = 0 THEN 'A' ELSE 'B' END AS cohort, avg(faded::INT) - 0.2 AS low, avg(faded::INT) + 0.1 AS high FROM fd GROUP BY ALL),
  k AS (SELECT factor, max(CASE WHEN low > 0.5 THEN 'more' WHEN high < 0.5 THEN 'less' END) FILTER (cohort = 'A') AS a, max(CASE WHEN low > 0.5 THEN 'more' WHEN high < 0.5 THEN 'less' END) FILTER (cohort = 'B') AS b FROM s GROUP BY factor)
  SELECT factor, coalesce(a = b, false) AS kept, CASE WHEN a = b THEN a END AS direction FROM k""")
def patterns(spark, sf):
    share = F.avg(F.col("faded").cast("double"))
    s = faded(spark, sf).groupBy(F.col("tier").alias("factor"), F.when(F.col("half") == 0, "A").otherwise("B").alias("cohort")).agg(
        (share - 0.2).alias("low"), (share + 0.1).alias("high"))
    return keep_patterns(s)


@query("early_share_facts", f"""WITH {EVENT_PANEL}, {label_ctes()}, x AS (SELECT entity, age, cl, coalesce(vel, 0) AS sp, pa FROM lab_c),
  f AS (SELECT entity, count(*) AS n, max(age) AS last, max(cl) AS fin, min(age) AS first, arg_min(cl, age) AS start, arg_max(sp, (sp, -age)) FILTER (pa IS NOT NULL) AS peak,
    arg_max(age, (sp, -age)) FILTER (pa IS NOT NULL) AS peak_at, max(age) FILTER (age < 96) AS a0, max(cl) FILTER (age < 96) AS c0, min(age) FILTER (age >= 96) AS a1, min(cl) FILTER (age >= 96) AS c1 FROM x GROUP BY entity),
  k AS (SELECT *, CASE WHEN a1 = 96 THEN c1 WHEN a0 IS NOT NULL THEN c0 + (96 - a0) / (a1 - a0) * (c1 - c0) ELSE start END / fin AS by_day FROM f WHERE n >= 3 AND fin > 0 AND last >= 400)
  SELECT count(*) AS entities, round(avg((peak_at <= 60)::INT), 6) AS share_fastest_early, round(median(by_day), 6) AS median_share_by_day FROM k""")
def early_facts(spark, sf):
    return early_share_facts(event_panel(spark, sf), first_hours=60.0, day=96.0, followed=400.0)


@query("predictions_written", f"WITH {STACK} SELECT model, count(*) AS entities, round(sum(predicted), 4) AS total FROM stk GROUP BY model")
def predictions_written(spark, sf):
    """The stacked predictions as files by model, read back."""
    d, path = life(spark, sf), fresh_folder(spark, "predictions")
    write_predictions({m: d.select("entity", F.col(m).alias("predicted")) for m in ("m1", "m2")}, path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("entities"), F.round(F.sum("predicted"), 4).alias("total"))


@query("decided_pairs")
def game_pairs(spark, sf):
    d = life(spark, sf).withColumnsRenamed({"event": "event_observed", "duration": "t_death"})
    return decided_pairs(d, 30, 24.0, PANEL.seed, picks={"model": "m1", "size": "m2"})


@query("saturation_frame", f"""WITH {LIFE}, d AS (SELECT entity, CASE WHEN n_intervals % 4 <> 0 THEN m1 - 200 END AS sat, last_observed_hours FROM life)
  SELECT entity, round(coalesce(sat, last_observed_hours - 28), 6) AS t_death, sat IS NOT NULL AS event_observed FROM d WHERE coalesce(sat, last_observed_hours - 28) > 0""")
def saturation_frame(spark, sf):
    d = life(spark, sf).withColumn("t_saturation", F.when(F.col("n_intervals") % 4 != 0, F.col("m1") - 200))
    return M.saturation_frame(d, 28.0).select("entity", "t_death", "event_observed")


@query("models_table", f"""WITH {STACK}, s AS (SELECT model, avg(abs(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)))) AS mae FROM stk WHERE event GROUP BY model)
  SELECT model, CASE WHEN model = 'm2' THEN 0.5 ELSE round_even(0.1234567::DOUBLE, 3) END AS c, CASE WHEN model <> 'm2' THEN 0.1::DOUBLE END AS lo, CASE WHEN model <> 'm2' THEN 0.2::DOUBLE END AS hi,
  round_even(pow(10, mae), 2) AS error_x FROM s""")
def models_table(spark, sf):
    s = M.log_errors(stacked(spark, sf), ["model"]).withColumns(
        {"c_index": F.lit(0.1234567), "c_low": F.lit(0.1), "c_high": F.lit(0.2)})
    return M.models_table(s, ("m2",))


@query("h2_table", f"""WITH {STACK}, s AS (SELECT model, avg(abs(log10(greatest(duration, 1e-6)) - log10(greatest(predicted, 1e-6)))) AS mae FROM stk WHERE event GROUP BY model)
  SELECT model, 'km' AS baseline, round_even(mae - 0.5, 3) AS dc, round_even(mae - 0.6, 3) AS lo, round_even(mae, 3) AS hi, round(mae / 10, 6) AS p,
  mae - 0.6 > 0 AND mae / 10 < 0.05 AS "both" FROM s""")
def h2_table(spark, sf):
    s = M.log_errors(stacked(spark, sf), ["model"]).withColumn("baseline", F.lit("km"))
    m = F.col("mae_log10")
    deltas = s.select("model", "baseline", (m - 0.5).alias("delta_c_index"), (m - 0.6).alias("delta_c_low"), m.alias("delta_c_high"))
    tests = s.select("model", "baseline", (m / 10).alias("p_value"), F.lit(-1.0).alias("median_diff"))
    return M.h2_table(deltas, tests)


@query("align_models", f"""WITH {STACK} SELECT a.entity, round(a.predicted - b.predicted, 6) AS gap FROM stk a JOIN stk b USING (entity) WHERE a.model = 'm1' AND b.model = 'm2'""")
def align_models(spark, sf):
    s = stacked(spark, sf)
    b = s.filter("model = 'm2'").select("entity", F.col("predicted").alias("other"))
    return s.filter("model = 'm1'").join(b, "entity").select("entity", (F.col("predicted") - F.col("other")).alias("gap"))


@query("set_operations", """SELECT 'kept' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10)
  UNION ALL SELECT 'common', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10)""")
def set_operations(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    c = table(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    n = lambda d, op: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(o.subtract(c), "kept").unionByName(n(o.intersect(c), "common"))

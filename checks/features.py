"""Early features, owner history, landmark inputs, the analysis frame."""

from pyspark.sql import functions as F

from checks.registry import query, r
from checks.views_sql import (EARLY_COLS, EVENT_PANEL, WEEKLY_ENTITIES, WEEKLY_PANEL, ORDER_ENTITIES, cap_ctes, early_ctes, label_ctes)
from ebbtide.functions import scalars as S
from ebbtide.operators import features as feat
from ebbtide.operators import silver
from ebbtide.operators.labels import decay_label
from ebbtide.plans import analysis as A
from ebbtide.plans.analysis import positive_duration
from ebbtide.plans.views import COHORTS, NOW, PANEL, event_panel, order_entities, table, weekly_entities, weekly_panel


@query("early_window", f"""WITH {WEEKLY_PANEL} SELECT entity, count(*) AS n, round(max(age_hours), 6) AS last_age
  FROM p WHERE age_hours <= {PANEL.feature_cutoff} GROUP BY entity""")
def early_window(spark, sf):
    d = feat.early_window(weekly_panel(spark, sf), PANEL.feature_cutoff)
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("age_hours").alias("last_age"))


@query("early_features", f"WITH {WEEKLY_PANEL}, {early_ctes()} SELECT {r(EARLY_COLS)} FROM ef")
def early_features(spark, sf):
    return feat.early_features(weekly_panel(spark, sf), PANEL).drop("n_values")


META = """md AS (SELECT entity, CAST(hour(published_at) AS BIGINT) AS publish_hour_utc,
  CAST(isodow(published_at) - 1 AS BIGINT) AS publish_weekday,
  CAST(CASE WHEN isodow(published_at) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS publish_is_weekend,
  CASE WHEN duration_sec > 0 THEN log10(duration_sec + 1) END AS log_duration_sec,
  CASE WHEN follower_count > 0 THEN log10(follower_count + 1) END AS log_follower_count FROM en)"""
META_COLS = "publish_hour_utc, publish_weekday, publish_is_weekend, ~log_duration_sec, ~log_follower_count"


@query("metadata_features", f"WITH {WEEKLY_ENTITIES}, {META} SELECT entity, {r(META_COLS)} FROM md")
def metadata_features(spark, sf):
    return feat.metadata_features(weekly_entities(spark, sf)).select(
        "entity", "publish_hour_utc", "publish_weekday", "publish_is_weekend", "log_duration_sec", "log_follower_count")


@query("build_features", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, {META}, {early_ctes()}
  SELECT {r(EARLY_COLS)}, {r(META_COLS)} FROM ef JOIN md USING (entity)""")
def build_features(spark, sf):
    d = feat.build_features(weekly_panel(spark, sf), weekly_entities(spark, sf), PANEL)
    return d.select(*[x.strip().lstrip("~#") for x in (EARLY_COLS + "," + META_COLS).split(",")])


@query("leak_check", f"""WITH {WEEKLY_PANEL}, {early_ctes()} SELECT entity, round(first_observed_at_hours, 6) AS first_observed_at_hours,
  coalesce(first_observed_at_hours > {PANEL.feature_cutoff / 2}, false) AS past_half, true AS passed FROM ef""")
def leak_check(spark, sf):
    """Features of the early window pass the check; held against half the window, some don't."""
    d = feat.assert_no_leak(feat.early_features(weekly_panel(spark, sf), PANEL), PANEL.feature_cutoff)
    past = F.coalesce(F.col("first_observed_at_hours") > PANEL.feature_cutoff / 2, F.lit(False))
    return d.select("entity", "first_observed_at_hours", past.alias("past_half"), F.lit(True).alias("passed"))


@query("owner_relative", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, {early_ctes()},
  j AS (SELECT en.entity, owner, published_at, velocity_to_m3 AS v FROM ef JOIN en USING (entity)),
  h AS (SELECT *, median(v) OVER w AS med0, count(v) OVER w AS n_prior FROM j
    WINDOW w AS (PARTITION BY owner ORDER BY published_at, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, CASE WHEN n_prior >= 2 THEN med0 END AS med FROM h)
  SELECT entity, CAST(n_prior AS BIGINT) AS n_prior, round(med, 6) AS owner_median_velocity_prior,
  round(CASE WHEN med > 0 THEN log10(med + 1) END, 6) + 0.0 AS log_owner_median_velocity,
  round(CASE WHEN med > 0 AND v > 0 THEN log10(v / med) END, 6) + 0.0 AS log_rel_velocity FROM k""")
def owner_relative(spark, sf):
    d = feat.build_features(weekly_panel(spark, sf), weekly_entities(spark, sf), PANEL)
    return feat.owner_relative(d, PANEL).select("entity", "n_prior", "owner_median_velocity_prior",
                                                "log_owner_median_velocity", "log_rel_velocity")


@query("prior_median_per_owner", """WITH h AS (SELECT o_orderkey, median(o_totalprice) OVER w AS m, count(*) OVER w AS n FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT CAST(o_orderkey AS VARCHAR) AS entity, round(m, 6) AS prior_median, n AS n_prior FROM h""")
def prior_median_per_owner(spark, sf):
    from ebbtide.operators.history import prior_median
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("entity"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), "o_totalprice")
    return prior_median(o, "o_totalprice")


@query("prior_median_hot_owners", """WITH h AS (SELECT o_orderkey, median(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END) OVER w AS m,
    count(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END) OVER w AS n FROM orders
    WINDOW w AS (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT CAST(o_orderkey AS VARCHAR) AS entity, round(m, 6) AS prior_median, n AS n_prior FROM h""")
def prior_median_hot_owners(spark, sf):
    """Three owners hold all orders; each is cut along time, and a value in nine is missing."""
    from ebbtide.operators.history import prior_median
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 3).cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("entity"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    return prior_median(o, "price", max_rows=1000)


@query("engagement_at", f"""WITH {WEEKLY_PANEL}, l AS (SELECT entity, arg_max(views, age_hours) AS views,
    arg_max(likes, CASE WHEN likes IS NOT NULL THEN age_hours END) AS likes, arg_max(comments, age_hours) AS comments
    FROM p WHERE age_hours <= {PANEL.landmark} GROUP BY entity)
  SELECT entity, round(CASE WHEN views > 0 AND likes IS NOT NULL THEN log10(greatest(likes / views::DOUBLE, 1e-5::DOUBLE)) END, 6) AS log_like_rate,
  round(CASE WHEN views > 0 THEN log10(greatest(comments / views::DOUBLE, 1e-6::DOUBLE)) END, 6) AS log_comment_rate FROM l""")
def engagement_at(spark, sf):
    return feat.engagement_at(weekly_panel(spark, sf), PANEL.landmark)


@query("trajectory_at", f"""WITH {WEEKLY_PANEL}, a AS (SELECT entity, age_hours,
    max(value) OVER (PARTITION BY entity ORDER BY age_hours ROWS UNBOUNDED PRECEDING) AS cl FROM p WHERE age_hours <= 100 AND value IS NOT NULL),
  b AS (SELECT *, CASE WHEN lag(age_hours) OVER e IS NOT NULL THEN (cl - lag(cl) OVER e) / (age_hours - lag(age_hours) OVER e) END AS sp
    FROM a WINDOW e AS (PARTITION BY entity ORDER BY age_hours)),
  c AS (SELECT entity, max(cl) AS lvl, max(sp) AS peak, arg_max(sp, CASE WHEN sp IS NOT NULL THEN age_hours END) AS latest FROM b GROUP BY entity)
  SELECT entity, round(log10(lvl + 1), 6) AS log_value_at_landmark,
  round(CASE WHEN peak > 0 THEN greatest(latest, 0) / peak END, 6) + 0.0 AS speed_share_at_landmark FROM c""")
def trajectory_at(spark, sf):
    return feat.trajectory_at(weekly_panel(spark, sf), 100.0)


@query("category_dummies", f"""WITH {WEEKLY_ENTITIES}, c AS (SELECT lower(trim(stratum_category)) AS cat, count(*) AS n FROM en
    WHERE stratum_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, cat LIMIT 3)
  SELECT entity, cat, CASE WHEN coalesce(lower(trim(stratum_category)) = cat, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM en, c""")
def category_dummies(spark, sf):
    d = feat.category_dummies(weekly_entities(spark, sf), limit=3)
    cats = [c for c in d.columns if c.startswith("cat_")]
    return d.select("entity", F.explode(F.array(*[F.struct(F.lit(c[4:]).alias("cat"), F.col(c).alias("flag"))
                                                  for c in cats])).alias("x")).select("entity", "x.*")


COVER = ("velocity_to_m1", "velocity_to_m3", "log_growth_12", "decay_ratio")


@query("feature_coverage", f"WITH {WEEKLY_PANEL}, {early_ctes()} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
    coalesce(min({c}) < max({c}), false) AS varies,
    avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5 AND coalesce(min({c}) < max({c}), false) AS usable FROM ef""" for c in COVER))
def feature_coverage(spark, sf):
    return feat.coverage_table(feat.early_features(weekly_panel(spark, sf), PANEL), COVER)


@query("varying_features", f"WITH {WEEKLY_PANEL}, {early_ctes()}, fo AS (SELECT *, CAST(split_part(entity, '_', 1) AS INT) % 3 AS fold FROM ef) " + " UNION ALL ".join(
    f"""SELECT CAST(fold AS BIGINT) AS fold, '{c}' AS feature, count({c}) AS n_values, round(median({c}), 6) + 0.0 AS median, count({c}) >= 10 AND coalesce(min({c}) < max({c}), false) AS kept FROM fo GROUP BY fold""" for c in COVER))
def varying_features(spark, sf):
    d = feat.early_features(weekly_panel(spark, sf), PANEL).withColumn("fold", F.split("entity", "_")[0].cast("int") % 3)
    return feat.varying_table(d, COVER, ["fold"])


@query("floored_durations", f"""WITH {EVENT_PANEL}, {label_ctes()}, d AS (SELECT entity, t_death - 100.0 AS t FROM lab WHERE exclude_reason IS NULL)
  SELECT entity, round(greatest(t, 0.001), 6) AS residual, t <= 0 AS floored FROM d""")
def floored_durations(spark, sf):
    """Durations that models cannot take are lifted, and each such row says so."""
    d = decay_label(event_panel(spark, sf), PANEL, seq="seq").filter("exclude_reason IS NULL").withColumn("residual", F.col("t_death") - 100.0)
    return positive_duration(d, "residual").select("entity", "residual", "floored")


@query("owner_daily_cap", f"""WITH {ORDER_ENTITIES}, {cap_ctes('oe', {'video': 1, 'photo': 0})}
  SELECT entity, owner, over_daily_cap FROM capped""")
def owner_daily_cap(spark, sf):
    return silver.owner_daily_cap(order_entities(spark, sf), {"video": 1, "photo": 0}).select(
        "entity", "owner", "over_daily_cap")


@query("drop_capped", f"""WITH {ORDER_ENTITIES}, {cap_ctes('oe', {'video': 2, 'photo': 1})}
  SELECT owner, count(*) AS kept FROM capped WHERE NOT over_daily_cap GROUP BY owner""")
def drop_capped(spark, sf):
    e = silver.owner_daily_cap(order_entities(spark, sf), {"video": 2, "photo": 1})
    return silver.drop_capped(e, e).groupBy("owner").agg(F.count(F.lit(1)).alias("kept"))


_CASES = " ".join(f"WHEN published_at < TIMESTAMP '{end}' THEN '{n}'" for n, end in COHORTS)
COHORT_CASE = f"CASE {_CASES} ELSE 'later' END"


@query("cohort_of", f"""WITH {WEEKLY_ENTITIES} SELECT {COHORT_CASE} AS cohort, count(*) AS entities,
  count(DISTINCT owner) AS owners FROM en GROUP BY 1""")
def cohort_of(spark, sf):
    return weekly_entities(spark, sf).groupBy(S.cohort_of("published_at", COHORTS).alias("cohort")).agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("owner").alias("owners"))


@query("cohort_filter", f"""WITH {WEEKLY_ENTITIES} SELECT entity FROM en
  WHERE published_at >= TIMESTAMP '{COHORTS[0][1]}' AND published_at < TIMESTAMP '{COHORTS[1][1]}'""")
def cohort_filter(spark, sf):
    return A.cohort_filter(weekly_entities(spark, sf), COHORTS[0][1], COHORTS[1][1]).select("entity")


@query("cohort_maturity", f"""WITH {WEEKLY_ENTITIES}, m AS (SELECT {COHORT_CASE} AS cohort,
    published_at + {int(PANEL.max_track)} * INTERVAL 1 HOUR AS done FROM en)
  SELECT cohort, count(*) AS n, CAST(count(*) FILTER (done > TIMESTAMP '{NOW}') AS BIGINT) AS immature,
  strftime(max(done), '%Y-%m-%d %H:%M:%S') AS matures_at, count(*) FILTER (done > TIMESTAMP '{NOW}') = 0 AS mature FROM m GROUP BY cohort""")
def cohort_maturity(spark, sf):
    e = weekly_entities(spark, sf).withColumn("cohort", S.cohort_of("published_at", COHORTS))
    return A.cohort_maturity(e, NOW, PANEL, ["cohort"])


@query("landmark_eligible", f"""WITH {WEEKLY_PANEL}, {label_ctes()} SELECT entity, event_observed,
  round(t_death - {PANEL.landmark}, 6) AS residual FROM lab WHERE exclude_reason IS NULL
  AND NOT (event_observed AND t_death <= {PANEL.landmark}) AND last_observed_hours >= {PANEL.landmark}""")
def landmark_eligible(spark, sf):
    from ebbtide.operators.labels import decay_label
    lab = decay_label(weekly_panel(spark, sf), PANEL, seq="seq").filter(F.col("exclude_reason").isNull())
    return A.landmark_eligible(lab, PANEL.landmark).select("entity", "event_observed", "residual")


def frame_ctes(cohort: str | None = None) -> str:
    """The staged analysis frame over the weekly panel as CTEs ending in `st`."""
    bounds = {"A": f"published_at < TIMESTAMP '{COHORTS[0][1]}'",
              "B": f"published_at >= TIMESTAMP '{COHORTS[0][1]}' AND published_at < TIMESTAMP '{COHORTS[1][1]}'"}
    outside = f"NOT ({bounds[cohort]})" if cohort else "false"
    L = PANEL.landmark
    return f"""{WEEKLY_PANEL}, {WEEKLY_ENTITIES}, {cap_ctes('en')}, {label_ctes()}, {early_ctes()},
st AS (SELECT ef.entity, owner, published_at, follower_count, stratum_tier, t_death AS t_death_from_publish, t_death - {L} AS t_death, event_observed,
  last_observed_hours, n_early_observations, log_value_m3, velocity_to_m3, CASE WHEN over_daily_cap THEN 'over owner daily cap'
  WHEN {outside} THEN 'outside cohort' WHEN n_values = 0 THEN 'no usable metric' WHEN exclude_reason IS NOT NULL THEN exclude_reason
  WHEN event_observed AND t_death <= {L} THEN 'died before the landmark' WHEN last_observed_hours < {L} THEN 'not yet observed at the landmark'
  WHEN n_early_observations = 0 THEN 'no early observation' END AS exclusion
  FROM ef LEFT JOIN capped USING (entity) LEFT JOIN lab USING (entity))"""


def staged(spark, sf, cohort=None, **kw):
    bounds = {None: {}, "A": {"end": COHORTS[0][1]}, "B": {"start": COHORTS[0][1], "end": COHORTS[1][1]}}[cohort]
    return A.analysis_frame(weekly_panel(spark, sf), weekly_entities(spark, sf), PANEL, **bounds, **kw)


@query("analysis_frame", f"""WITH {frame_ctes()} SELECT entity, owner, event_observed,
  {r('~t_death, ~t_death_from_publish, ~log_value_m3, #n_early_observations')} FROM st WHERE exclusion IS NULL""")
def analysis_frame(spark, sf):
    return staged(spark, sf).frame.select("entity", "owner", "event_observed", "t_death", "t_death_from_publish",
                                          "log_value_m3", "n_early_observations")


@query("analysis_frame_cohort_b", f"""WITH {frame_ctes('B')} SELECT entity, owner, event_observed,
  {r('~t_death, ~log_value_m3')} FROM st WHERE exclusion IS NULL""")
def analysis_frame_b(spark, sf):
    return staged(spark, sf, "B").frame.select("entity", "owner", "event_observed", "t_death", "log_value_m3")


@query("attrition", f"WITH {frame_ctes('A')}, s(ord, stage) AS (VALUES (0, 'observed'), " + ", ".join(
    f"({i + 1}, '{s}')" for i, s in enumerate(A.STAGES)) + f""", ({len(A.STAGES) + 1}, 'final analysis set'))
  SELECT CAST(ord AS BIGINT) AS ord, CASE WHEN ord BETWEEN 1 AND {len(A.STAGES)} THEN 'excluded: ' || stage ELSE stage END AS stage,
  CAST(CASE WHEN ord = 0 THEN (SELECT count(*) FROM st) WHEN ord = {len(A.STAGES) + 1} THEN (SELECT count(*) FROM st WHERE exclusion IS NULL)
  ELSE -(SELECT count(*) FROM st WHERE exclusion = stage) END AS BIGINT) AS n FROM s""")
def attrition(spark, sf):
    return staged(spark, sf, "A").attrition()


@query("landmark_sweep", f"WITH {WEEKLY_PANEL}, " + ", ".join(label_ctes(frac=f, out=f"lab{i}") for i, f in enumerate((0.02, 0.1)))
       + ", al AS (" + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS frac, * FROM lab{i}" for i, f in enumerate((0.02, 0.1)))
       + """), l(landmark) AS (VALUES (12.0::DOUBLE), (28.0::DOUBLE), (48.0::DOUBLE))
  SELECT landmark, frac, count(*) AS entities, CAST(count(*) FILTER (event_observed) AS BIGINT) AS events, round(avg(t_death - landmark), 6) AS mean_residual
  FROM al, l WHERE exclude_reason IS NULL AND last_observed_hours >= landmark AND NOT (event_observed AND t_death <= landmark) GROUP BY landmark, frac""")
def landmark_sweep(spark, sf):
    return A.landmark_sweep(weekly_panel(spark, sf), weekly_entities(spark, sf), [12.0, 28.0, 48.0], [0.02, 0.1], PANEL)


@query("owner_history_frame")
def owner_history_frame(spark, sf):
    d = A.with_owner_history(staged(spark, sf).frame, PANEL)
    return d.select("entity", "n_prior", "log_owner_median_velocity", *[c for c in d.columns if c.startswith("cat_")])


@query("saturation_analysis")
def saturation_analysis(spark, sf):
    from ebbtide.operators.metrics import saturation_frame
    d = staged(spark, sf, saturation=True).frame
    return saturation_frame(d, PANEL.landmark).select("entity", "t_death", "event_observed", "saturation_beyond_window")

"""Scalars, one-reading tables, comparisons, sampling frame, exports."""

from pyspark.sql import functions as F

from checks.registry import query, r
from checks.views_sql import EVENT_PANEL, WEEKLY_ENTITIES, WEEKLY_PANEL, hours, label_ctes
from ebbtide.config import INSTANT_COLUMNS
from ebbtide.functions import scalars as S
from ebbtide.operators import frame as FR
from ebbtide.operators import tables as TB
from ebbtide.operators.labels import decay_label
from ebbtide.plans.scaling import amplify
from ebbtide.session import cut_lineage
from ebbtide.plans.views import COHORTS, PANEL, event_panel, table, weekly_entities, weekly_panel

E, L = PANEL.tolerance, PANEL.late_tolerance
MARK_FIRST = "CASE " + " ".join(f"WHEN age_hours BETWEEN {m - E!r} AND {m + L!r} THEN {m!r}::DOUBLE" for m in PANEL.marks) + " END"
MARK_LAST = "CASE " + " ".join(f"WHEN age_hours BETWEEN {m - E!r} AND {m + L!r} THEN {m!r}::DOUBLE" for m in reversed(PANEL.marks)) + " END"
FADE = lambda t: "CASE " + " ".join(f"WHEN {m!r}::DOUBLE <= {t} + {E} THEN {m!r}::DOUBLE" for m in reversed(PANEL.marks)) + f" ELSE {PANEL.marks[0]!r}::DOUBLE END"


@query("mark_of", f"WITH {WEEKLY_PANEL}, m AS (SELECT entity, seq, {MARK_FIRST} AS mark FROM p) SELECT entity, seq, mark FROM m WHERE mark IS NOT NULL")
def mark_of(spark, sf):
    return weekly_panel(spark, sf).select("entity", "seq", S.mark_of("age_hours", PANEL).alias("mark")).filter(F.col("mark").isNotNull())


@query("nearest_checkpoint", f"""WITH {WEEKLY_PANEL}, c(cp) AS (VALUES {', '.join(f'({c!r}::DOUBLE)' for c in PANEL.checkpoints)})
  SELECT entity, seq, arg_min(cp, (abs(ln(age_hours / cp)), cp)) AS cp FROM p, c WHERE age_hours > 0 GROUP BY entity, seq""")
def nearest_checkpoint(spark, sf):
    return weekly_panel(spark, sf).filter("age_hours > 0").select("entity", "seq", S.nearest_checkpoint("age_hours", PANEL).alias("cp"))


@query("fade_mark", f"WITH {EVENT_PANEL}, {label_ctes()} SELECT entity, {FADE('t_death')} AS fade_h FROM lab WHERE t_death IS NOT NULL")
def fade_mark(spark, sf):
    return decay_label(event_panel(spark, sf), PANEL, seq="seq").filter(F.col("t_death").isNotNull()).select(
        "entity", S.fade_mark("t_death", PANEL).alias("fade_h"))


FOLD = "list_sum(list_transform(string_split(sha256({x}), ''), lambda d: strpos('0123456789abcdef', d) - 1)) % 5"


@query("owner_fold", f"SELECT c_custkey, CAST({FOLD.format(x='c_name')} AS BIGINT) AS fold FROM customer")
def owner_fold(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.owner_fold("c_name").alias("fold"))


@query("sql_functions", f"""SELECT c_custkey, CAST({FOLD.format(x='c_name')} AS BIGINT) AS fold, CASE WHEN c_acctbal < 10000 THEN 'micro' ELSE 'mid' END AS tier,
  nullif(CAST((c_custkey % 7) * 60 AS DOUBLE), 0) AS sec FROM customer""")
def sql_functions(spark, sf):
    """The registered SQL functions, called from SQL."""
    from ebbtide.functions.register import register
    register(spark, PANEL)
    table(spark, sf, "customer").createOrReplaceTempView("_customer")
    return spark.sql("SELECT c_custkey, owner_fold(c_name) AS fold, tier_of(c_acctbal) AS tier, "
                     "iso_duration_seconds(concat('PT', c_custkey % 7, 'M')) AS sec FROM _customer")


@query("size_bands", """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * c_custkey END AS n FROM customer)
  SELECT c_custkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 10000 THEN 'micro' WHEN n < 500000 THEN 'mid' ELSE 'large' END AS tier,
  CASE WHEN n IS NULL THEN 'unknown size' WHEN n < 1e4 THEN 'under 10k' WHEN n < 1e5 THEN '10k-100k' WHEN n < 5e5 THEN '100k-500k' WHEN n < 5e6 THEN '500k-5M' ELSE 'over 5M' END AS band,
  CASE WHEN n IS NULL OR n <= 0 THEN NULL WHEN log10(n) < 4 THEN 'under 10,000' WHEN log10(n) < 6 THEN '10,000 to 1 million' ELSE 'over 1 million' END AS ref_band FROM c""")
def size_bands(spark, sf):
    n = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", S.tier_of(n).alias("tier"), S.disclosure_band(n).alias("band"),
                                               S.reference_band(S.log10_or_null(n)).alias("ref_band"))


@query("round_sig2", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 5000 WHEN o_orderkey % 9 = 0 THEN -1.0::DOUBLE ELSE o_totalprice END AS v FROM orders)
  SELECT o_orderkey, CAST(CASE WHEN v < 0 THEN 0 WHEN v < 100 THEN round_even(v, 0) ELSE round_even(v / pow(10, floor(log10(v)) - 1), 0) * pow(10, floor(log10(v)) - 1) END AS BIGINT) AS v FROM x""")
def round_sig2(spark, sf):
    v = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") / 5000).when(F.col("o_orderkey") % 9 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", S.round_sig2(v).alias("v"))


lg = lambda x: f"round_even(log10({x}), 2) + 0.0"
INSTANT_SQL = f"""round_even(age_hours, 2) AS age_h, {lg('views + 1')} AS log_views, {lg('views / age_hours + 1')} AS log_views_per_h,
  CASE WHEN views > 0 AND likes IS NOT NULL THEN {lg('greatest(likes / views::DOUBLE, 1e-5::DOUBLE)')} END AS log_like_rate,
  CASE WHEN views > 0 AND comments IS NOT NULL THEN {lg('greatest(comments / views::DOUBLE, 1e-6::DOUBLE)')} END AS log_comment_rate,
  CASE WHEN follower_count > 0 THEN {lg('(views + 1) / follower_count::DOUBLE')} END AS log_views_per_sub,
  CASE WHEN follower_count > 0 THEN {lg('follower_count + 1')} END AS log_subscribers, CASE WHEN duration_sec > 0 THEN {lg('duration_sec + 1')} END AS log_duration_sec,
  CAST(hour(en.published_at) AS DOUBLE) AS publish_hour_utc, CAST(title_len AS DOUBLE) AS title_len"""
INSTANT_COLS = ", ".join("~" + x for x in INSTANT_COLUMNS)


@query("instant_features", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, x AS (SELECT entity, p.seq, {INSTANT_SQL} FROM p JOIN en USING (entity) WHERE age_hours > 0 AND views >= 0)
  SELECT entity, seq, {r(INSTANT_COLS)} FROM x""")
def instant_features(spark, sf):
    d = weekly_panel(spark, sf).filter(S.instant_valid()).drop("published_at", "owner", "source").join(
        weekly_entities(spark, sf).withColumn("publish_hour_utc", F.hour("published_at")), "entity")
    f = S.instant_features()
    return d.select("entity", "seq", *[f[n].alias(n) for n in INSTANT_COLUMNS])


@query("rejected_readings", f"""WITH {WEEKLY_PANEL} SELECT CASE WHEN age_hours <= 40 THEN 'age not positive' ELSE 'views missing or negative' END AS reason, count(*) AS n
  FROM p WHERE age_hours <= 40 OR views % 2 = 0 GROUP BY 1""")
def rejected_readings(spark, sf):
    d = weekly_panel(spark, sf).withColumns({"age_hours": F.col("age_hours") - 40, "views": F.when(F.col("views") % 2 != 0, F.col("views"))})
    return TB.rejected_readings(d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


PER_MARK = f"""pm0 AS (SELECT *, {MARK_LAST} AS mark FROM p WHERE views IS NOT NULL), pm AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY entity, mark ORDER BY abs(age_hours - mark), age_hours, views) AS rn FROM pm0 WHERE mark IS NOT NULL) WHERE rn = 1)"""


@query("reading_per_mark", f"WITH {WEEKLY_PANEL}, {PER_MARK} SELECT entity, mark, seq, {r('~age_hours')} FROM pm")
def reading_per_mark(spark, sf):
    return TB.reading_per_mark(weekly_panel(spark, sf), PANEL).select("entity", "mark", "seq", "age_hours")


@query("offgrid_readings", f"""WITH {WEEKLY_PANEL} SELECT entity, seq, {r('~age_hours')} FROM p WHERE views IS NOT NULL AND age_hours BETWEEN {PANEL.min_odds_age} AND {PANEL.max_odds_age} AND {MARK_FIRST} IS NULL""")
def offgrid_readings(spark, sf):
    return TB.offgrid_readings(weekly_panel(spark, sf), PANEL).select("entity", "seq", "age_hours")


SIM = (8.0, 18.0, 36.0)


@query("simulated_readings", f"""WITH {WEEKLY_PANEL}, t(x) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in SIM)}),
  b AS (SELECT entity, x, max(age_hours) FILTER (age_hours < x) AS a0, min(age_hours) FILTER (age_hours >= x) AS a1 FROM p, t WHERE views IS NOT NULL GROUP BY entity, x),
  j AS (SELECT b.*, l.views AS v0, h.views AS v1, l.likes AS l0, h.likes AS l1, l.comments AS c0, h.comments AS c1 FROM b JOIN p l ON l.entity = b.entity AND l.age_hours = a0
    JOIN p h ON h.entity = b.entity AND h.age_hours = a1 WHERE a1 - a0 <= {PANEL.simulation_max_gap})
  SELECT entity, x AS age_hours, round(v0 + (x - a0) / (a1 - a0) * (v1 - v0), 6) AS views, round(c0 + (x - a0) / (a1 - a0) * (c1 - c0), 6) AS comments FROM j""")
def simulated_readings(spark, sf):
    return TB.simulated_readings(weekly_panel(spark, sf), SIM, PANEL).select("entity", "age_hours", "views", "comments")


_COH = "CASE " + " ".join(f"WHEN published_at < TIMESTAMP '{end}' THEN '{n}'" for n, end in COHORTS) + " ELSE 'later' END"
TRAIN = f"""{WEEKLY_PANEL}, {WEEKLY_ENTITIES}, {label_ctes()}, {PER_MARK},
  tt AS (SELECT pm.entity, en.owner, {_COH.replace('published_at', 'en.published_at')} AS cohort, mark, age_hours, {INSTANT_SQL}, {FADE('t_death')} AS fade_h, event_observed AS faded
  FROM pm JOIN en ON en.entity = pm.entity JOIN lab ON lab.entity = pm.entity WHERE exclude_reason IS NULL AND age_hours > 0 AND views >= 0)"""


def labelled(spark, sf):
    lab = decay_label(weekly_panel(spark, sf), PANEL, seq="seq").filter(F.col("exclude_reason").isNull())
    return weekly_entities(spark, sf).withColumn("cohort", S.cohort_of("published_at", COHORTS)).join(lab, "entity")


def training(spark, sf):
    return TB.training_table(TB.reading_per_mark(weekly_panel(spark, sf), PANEL), labelled(spark, sf), PANEL)


@query("training_table", f"WITH {TRAIN} SELECT entity, owner, cohort, mark, {r('~age_hours')}, {r(INSTANT_COLS)}, fade_h, faded FROM tt")
def training_table(spark, sf):
    return training(spark, sf).drop("entity_key")


@query("model_rows", f"WITH {TRAIN} SELECT mark, count(*) AS n, count(*) FILTER (faded) AS faded FROM tt WHERE mark IN ({', '.join(map(str, PANEL.checkpoints))}) GROUP BY mark")
def model_rows(spark, sf):
    return TB.model_rows(training(spark, sf), PANEL).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count_if("faded").alias("faded"))


@query("known_status", f"""WITH {TRAIN}, h(h) AS (VALUES {', '.join(f'({h!r}::DOUBLE)' for h in PANEL.horizons)})
  SELECT h, count(*) FILTER (faded OR fade_h > h) AS known, count(*) FILTER (faded AND fade_h <= h) AS ended FROM tt, h GROUP BY h""")
def known_status(spark, sf):
    from ebbtide.operators.metrics import known_status as known, outcome_at
    t = training(spark, sf)
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), known(h).alias("k"), outcome_at(h).alias("y")) for h in PANEL.horizons]))
    return t.select(cells.alias("c")).groupBy(F.col("c.h").alias("h")).agg(F.count_if("c.k").alias("known"), F.count_if("c.y").alias("ended"))


def chances(t):
    """Simple stand-in chances at each horizon, so scores can be checked without a trained model."""
    cols = {}
    for h in PANEL.horizons:
        cols[f"raw_{h:g}"] = 1 - F.exp(-F.lit(h) / (F.lit(100.0) + F.lit(20.0) * F.col("log_views")))
        cols[f"avg_{h:g}"] = F.lit(h) / (h + 150.0)
    return t.withColumns(cols)


CHANCE = f"{TRAIN}, ch AS (SELECT *, " + ", ".join(
    f"1 - exp(-{h!r}::DOUBLE / (100.0::DOUBLE + 20.0::DOUBLE * log_views)) AS raw_{h:g}, {h / (h + 150.0)!r}::DOUBLE AS avg_{h:g}" for h in PANEL.horizons) + " FROM tt)"
FAST = PANEL.fast_hours


@query("brier_skill", f"""WITH {CHANCE}, k AS (SELECT mark, raw_{FAST:g} AS p, avg_{FAST:g} AS a, (faded AND fade_h <= {FAST})::INT AS y FROM ch WHERE faded OR fade_h > {FAST})
  SELECT mark, count(*) AS rows, round(avg(y), 6) AS observed, round(avg(p), 6) AS predicted, round(1 - sum(pow(p - y, 2)) / sum(pow(a - y, 2)), 6) AS brier_skill FROM k GROUP BY mark""")
def brier_skill(spark, sf):
    from ebbtide.operators.metrics import brier_skill as skill
    return skill(chances(training(spark, sf)), FAST, f"raw_{FAST:g}", f"avg_{FAST:g}", ["mark"])


LOSSES = f"{CHANCE}, bb AS (SELECT i, i / 100.0::DOUBLE AS b FROM range(101) t(i)), ll AS (" + " UNION ALL ".join(
    f"""SELECT i, avg(pow(1 - exp(b * ln(greatest(least(1 - raw_{h:g}, 1), 1e-6)) + (1 - b) * ln(greatest(least(1 - avg_{h:g}, 1), 1e-6))) - (faded AND fade_h <= {h!r})::INT, 2)) AS loss
    FROM ch, bb WHERE faded OR fade_h > {h!r} GROUP BY i""" for h in PANEL.horizons) + "), lo AS (SELECT i / 100.0::DOUBLE AS b, sum(loss) AS loss FROM ll GROUP BY i)"


@query("blend_losses", f"WITH {LOSSES} SELECT {r('~b, ~loss')} FROM lo")
def blend_losses(spark, sf):
    from ebbtide.operators.metrics import blend_losses as losses
    return losses(chances(training(spark, sf)), PANEL)


@query("fit_blend_weight", f"WITH {LOSSES} SELECT round(arg_min(b, (round(loss, 12), b)), 6) AS b, round(min(loss), 6) AS loss FROM lo")
def fit_blend_weight(spark, sf):
    from ebbtide.operators.metrics import fit_blend_weight as fit
    return fit(chances(training(spark, sf)), PANEL)


@query("risk_band", f"""WITH {CHANCE} SELECT CASE WHEN raw_{FAST:g} >= 0.75 THEN 'high' WHEN raw_{FAST:g} <= 0.68 THEN 'low' ELSE 'typical' END AS band, count(*) AS n FROM ch GROUP BY 1""")
def risk_band(spark, sf):
    return chances(training(spark, sf)).groupBy(S.risk_band(f"raw_{FAST:g}", 0.75, 0.68).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("report_state", f"""WITH {WEEKLY_PANEL}, s AS (SELECT seq, age_hours - 6 AS a, CASE WHEN seq % 13 <> 0 THEN views END AS v, CASE WHEN seq % 10 = 0 THEN 'live' ELSE 'none' END AS live FROM p),
  z AS (SELECT *, CASE WHEN live = 'live' OR a <= 0 THEN 'live' WHEN v IS NULL THEN 'no_numbers' WHEN a > {PANEL.marks[-1] + L} THEN 'beyond_window' WHEN a < {PANEL.min_odds_age} THEN 'too_new'
   WHEN a > {PANEL.max_odds_age} THEN 'too_old_for_odds' ELSE 'ok' END AS state FROM s)
  SELECT seq, state, CASE WHEN state = 'too_new' THEN CAST(ceil(({PANEL.min_odds_age}::DOUBLE - a) * 60) AS BIGINT) END AS minutes_until_ready FROM z""")
def report_state(spark, sf):
    s = S.report_state("a", "v", "live", PANEL)
    return weekly_panel(spark, sf).select(
        "seq", (F.col("age_hours") - 6).alias("a"), F.when(F.col("seq") % 13 != 0, F.col("views")).alias("v"),
        F.when(F.col("seq") % 10 == 0, "live").otherwise("none").alias("live")).select("seq", *[v.alias(k) for k, v in s.items()])


@query("anonymise", f"""WITH {TRAIN} SELECT cohort, mark, {r(INSTANT_COLS)}, fade_h, faded, (SELECT count(DISTINCT entity) FROM tt) AS n_video, (SELECT count(DISTINCT owner) FROM tt) AS n_channel FROM tt""")
def anonymise(spark, sf):
    """The export without the arbitrary numbers, plus how many of each there are."""
    a = TB.anonymise(training(spark, sf), max_rows=50)
    top = a.agg((F.max("video") + 1).alias("n_video"), (F.max("channel") + 1).alias("n_channel"))
    return a.drop("video", "channel").crossJoin(F.broadcast(top))                     # one row


@query("table_digest")
def table_digest(spark, sf):
    t = training(spark, sf)
    again = t.repartition(7, "mark")
    return TB.table_digest(t).withColumn("build", F.lit(1)).unionByName(TB.table_digest(again).withColumn("build", F.lit(2)))


def percentile_ctes(feature: str) -> str:
    """Mid-rank percentiles at the two marks around each age, with the size-band fallback."""
    lo = "CASE " + " ".join(f"WHEN {m!r} <= a THEN {m!r}::DOUBLE" for m in reversed(PANEL.marks)) + f" ELSE {PANEL.marks[0]!r}::DOUBLE END"
    hi = "CASE " + " ".join(f"WHEN {m!r} >= a THEN {m!r}::DOUBLE" for m in PANEL.marks) + f" ELSE {PANEL.marks[-1]!r}::DOUBLE END"
    band = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 4 THEN 'under 10,000' WHEN {x} < 6 THEN '10,000 to 1 million' ELSE 'over 1 million' END"
    return f"""rf AS (SELECT mark, 'all' AS band, {feature} AS x, owner FROM tt WHERE {feature} IS NOT NULL UNION ALL
    SELECT mark, {band('log_subscribers')}, {feature}, owner FROM tt WHERE {feature} IS NOT NULL AND log_subscribers IS NOT NULL),
  sz AS (SELECT mark, band, count(*) AS n, count(DISTINCT owner) AS ow FROM rf GROUP BY ALL),
  q0 AS (SELECT p.seq AS id, CASE WHEN views > 0 THEN round_even(log10(views + 1), 2) END AS x, age_hours AS age, greatest(least(age_hours, {PANEL.marks[-1]}), {PANEL.marks[0]}) AS a,
    {band("CASE WHEN follower_count > 0 THEN round_even(log10(follower_count + 1), 2) END")} AS own FROM p JOIN en USING (entity)),
  q1 AS (SELECT *, {lo} AS lo, {hi} AS hi FROM q0 WHERE x IS NOT NULL), q2 AS (SELECT *, unnest(list_distinct([lo, hi])) AS mark FROM q1),
  q3 AS (SELECT q2.*, CASE WHEN f.band IS NOT NULL THEN q2.own ELSE 'all' END AS band FROM q2 LEFT JOIN sz f ON f.mark = q2.mark AND f.band = q2.own AND f.n >= 100 AND f.ow >= 5),
  rc AS (SELECT mark, band, x, count(*) AS c FROM rf GROUP BY ALL),
  q4 AS (SELECT q3.id, q3.lo, q3.hi, q3.age, q3.mark, 100.0 * (sum(CASE WHEN rc.x < q3.x THEN c ELSE 0 END) + 0.5 * sum(CASE WHEN rc.x = q3.x THEN c ELSE 0 END)) / sum(c) AS pct, CAST(sum(c) AS BIGINT) AS n
    FROM q3 LEFT JOIN rc ON rc.mark = q3.mark AND rc.band = q3.band GROUP BY ALL),
  pc AS (SELECT id, max(CASE WHEN mark = lo THEN pct END) AS p_lo, max(CASE WHEN mark = hi THEN pct END) AS p_hi, max(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(age) AS age FROM q4 GROUP BY id),
  po AS (SELECT q3.id, count(DISTINCT rf.owner) AS owners FROM q3 LEFT JOIN (SELECT DISTINCT mark, band, owner FROM rf) rf ON rf.mark = q3.mark AND rf.band = q3.band GROUP BY q3.id)"""


@query("midrank_percentile", f"""WITH {TRAIN}, {percentile_ctes('log_views')} SELECT id, round(CASE WHEN hi > lo THEN
  (1 - (ln(greatest(least(age, hi), lo)) - ln(lo)) / (ln(hi) - ln(lo))) * p_lo + (ln(greatest(least(age, hi), lo)) - ln(lo)) / (ln(hi) - ln(lo)) * p_hi ELSE p_lo END, 6) + 0.0 AS percentile, n AS reference_rows, owners AS reference_owners FROM pc JOIN po USING (id)""")
def midrank_percentile(spark, sf):
    f = S.instant_features()
    asked = weekly_panel(spark, sf).drop("published_at", "owner", "source").join(
        weekly_entities(spark, sf).withColumn("publish_hour_utc", F.hour("published_at")), "entity").select(
        F.col("seq").alias("id"), F.when(F.col("views") > 0, f["log_views"]).alias("value"), "age_hours", f["log_subscribers"].alias("log_subscribers"))
    return TB.midrank_percentile(training(spark, sf), asked, "log_views", PANEL).select("id", "percentile", "reference_rows", "reference_owners")


@query("steady_entities", f"""WITH {WEEKLY_PANEL}, o AS (SELECT entity, value, row_number() OVER e AS r, lag(value) OVER e AS before, count(*) OVER (PARTITION BY entity) AS n
    FROM p WHERE value IS NOT NULL WINDOW e AS (PARTITION BY entity ORDER BY age_hours, seq))
  SELECT entity FROM o WHERE r <= 4 AND n >= 6 GROUP BY entity HAVING bool_and(r = 1 OR value > before) AND max(CASE WHEN r = 2 THEN value END) > 0""")
def steady_entities(spark, sf):
    return TB.steady(weekly_panel(spark, sf), least=6, rising=4, seq="seq")


@query("example_picks")
def example_picks(spark, sf):
    d = labelled(spark, sf)
    return TB.example_picks(d, {"small, ended": (F.col("stratum_tier") == "micro") & F.col("event_observed"),
                                "mid, ended": (F.col("stratum_tier") == "mid") & F.col("event_observed"),
                                "still going": ~F.col("event_observed")}, PANEL.seed)


@query("fresh_candidates", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, c AS (SELECT entity, {hours('published_at', "TIMESTAMP '2024-01-30 12:00:00'")} AS age_now FROM en),
  l AS (SELECT entity, max(age_hours) AS age_hours, arg_max(views, age_hours) AS views FROM p WHERE views IS NOT NULL AND reading_ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY entity)
  SELECT entity, round(age_now, 6) AS age_now, round(age_hours, 6) AS age_hours, views FROM c JOIN l USING (entity)
  WHERE age_now BETWEEN {PANEL.min_odds_age} AND {PANEL.max_odds_age - L} AND age_hours >= {PANEL.min_odds_age}""")
def fresh_candidates(spark, sf):
    now = "2024-01-30 12:00:00"
    p = weekly_panel(spark, sf).filter(F.col("reading_ts") <= F.lit(now).cast("timestamp"))
    e = weekly_entities(spark, sf).withColumn("over_daily_cap", F.lit(False))
    return TB.fresh_candidates(e, p, now, PANEL).select("entity", "age_now", "age_hours", "views")


@query("table_digest_agrees", f"WITH {TRAIN} SELECT count(*) AS rows, true AS same, false AS same_without_a_row FROM tt")
def table_digest_agrees(spark, sf):
    """The digest of the training table does not depend on how it is dealt out, and sees one row less."""
    t = cut_lineage(training(spark, sf))
    one, two, less = TB.table_digest(t), TB.table_digest(t.repartition(7, "mark")), TB.table_digest(t.filter(F.xxhash64("entity", "mark") != t.agg(F.min(F.xxhash64("entity", "mark"))).first()[0]))
    pick = lambda d, n: d.select(F.col("digest").alias(n))
    j = one.crossJoin(pick(two, "d2")).crossJoin(pick(less, "d3"))                       # one row each
    return j.select("rows", (F.col("digest") == F.col("d2")).alias("same"), (F.col("digest") == F.col("d3")).alias("same_without_a_row"))


@query("amplify", f"""WITH {EVENT_PANEL} SELECT owner || s AS owner, count(*) AS n, count(DISTINCT entity) AS entities
  FROM p, (VALUES (''), ('_r1'), ('_r2')) AS c(s) GROUP BY 1""")
def amplified(spark, sf):
    return amplify(event_panel(spark, sf), 3).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


# ---------------------------------------------------------------- sampling frame
FLOORS = {"micro": 1_000, "mid": 10_000}


def accounts(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("owner"), F.col("c_mktsegment").alias("found_category"),
                    F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") * 20).cast("bigint")).alias("subscriber_count"),
                    (F.col("c_custkey") % 40).alias("video_count"))


def uploads(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderdate").cast("timestamp").alias("uploaded_at"))


TIER_SQL = "CASE WHEN n IS NULL THEN 'unknown' WHEN n < 10000 THEN 'micro' WHEN n < 500000 THEN 'mid' ELSE 'large' END"
ACC = f"""ac0 AS (SELECT CAST(c_custkey AS VARCHAR) AS owner, c_custkey % 40 AS video_count, CASE WHEN c_acctbal > 0 THEN CAST(trunc(c_acctbal * 20) AS BIGINT) END AS n FROM customer),
  ac AS (SELECT *, {TIER_SQL} AS tier FROM ac0)"""


@query("upload_rates", """WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
  SELECT owner, n AS uploads_seen, round(n / (30 / 7.0), 6) AS uploads_per_week, n >= 6 AS saturated FROM u""")
def upload_rates(spark, sf):
    return FR.upload_rates(uploads(spark, sf), "1996-01-01", 30, 6)


def spread_sql(src: str, k: int, out: str) -> str:
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n, owner) - 1 AS rn, count(*) OVER (PARTITION BY tier) AS cnt FROM {src}),
  {out} AS (SELECT * EXCLUDE (rn, cnt) FROM {out}_r WHERE cnt <= {k} OR (ceil(rn * {k} / cnt::DOUBLE) < {k} AND floor(ceil(rn * {k} / cnt::DOUBLE) * cnt / {k}) = rn))"""


@query("even_spread", f"WITH {ACC}, pool AS (SELECT * FROM ac WHERE n IS NOT NULL), {spread_sql('pool', 20, 'sp')} SELECT owner, tier FROM sp")
def even_spread(spark, sf):
    pool = accounts(spark, sf).filter(F.col("subscriber_count").isNotNull()).withColumn("tier", S.tier_of("subscriber_count"))
    return FR.even_spread(pool, "tier", ["subscriber_count", "owner"], 20, max_rows=30).select("owner", "tier")


@query("first_hits", """WITH h AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, o_orderpriority AS query, substr(o_orderpriority, 1, 1) AS ord FROM orders WHERE o_custkey % 10 <> 0)
  SELECT owner, arg_min(query, ord) AS query FROM h GROUP BY owner""")
def first_hits(spark, sf):
    o = table(spark, sf, "orders")
    hits = o.select(F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderpriority").alias("category"),
                    F.col("o_orderpriority").alias("query"), F.substring("o_orderpriority", 1, 1).alias("query_order"))
    known = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("owner"))
    return FR.first_hits(hits, known).select("owner", "query")


@query("build_frame", f"""WITH {ACC}, h AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS owner FROM orders WHERE o_custkey % 10 <> 0),
  ok AS (SELECT ac.* FROM ac JOIN h USING (owner) WHERE coalesce(n, 0) >= CASE tier WHEN 'micro' THEN 1000 WHEN 'mid' THEN 10000 END AND video_count >= 10),
  {spread_sql('ok', 36, 'wide')}, u AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, count(*) AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
  rated AS (SELECT wide.* FROM wide JOIN u USING (owner) WHERE c < 6 AND least(c, 6) / (30 / 7.0) >= 0.5), {spread_sql('rated', 12, 'fr')} SELECT owner, tier FROM fr""")
def build_frame(spark, sf):
    o = table(spark, sf, "orders")
    hits = o.select(F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderpriority").alias("category"),
                    F.col("o_orderpriority").alias("query"), F.substring("o_orderpriority", 1, 1).alias("query_order"))
    known = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("owner"))
    return FR.build_frame(hits, known, accounts(spark, sf), uploads(spark, sf), "1996-01-01", FLOORS, per_tier=12,
                          min_per_week=0.5, cap=6).select("owner", "tier")


@query("frame_health", f"""WITH ac0 AS (SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN c_acctbal > 0 THEN CAST(trunc(c_acctbal * 20) AS BIGINT) END AS n FROM customer),
  ac AS (SELECT *, {TIER_SQL} AS tier FROM ac0)
  SELECT tier, count(*) AS owners, count(DISTINCT c_mktsegment) AS categories, count(*) FILTER (tier <> 'mid') AS reclassified, (SELECT count(*) FROM ac) AS frame_total,
  tier IN ('micro', 'mid', 'large') AND count(*) < 10 AS tier_too_small, (SELECT count(*) FROM ac) < 60 AS frame_too_small FROM ac GROUP BY tier""")
def frame_health(spark, sf):
    a = accounts(spark, sf).withColumnRenamed("found_category", "category").withColumn("tier_declared", F.lit("mid"))
    return FR.frame_health(a)


def items(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("owner"), F.col("ts").cast("timestamp").alias("published_at"),
                    (F.col("event_id") % 23 == 0).alias("is_pinned"),
                    ((F.col("user_id") % 19 == 0) & (F.col("event_type") == "error")).alias("counts_hidden"))


SCREEN = f"""s0 AS (SELECT CAST(user_id AS VARCHAR) AS owner, count(*) AS items, count(*) FILTER (event_id % 23 = 0) AS pinned, count(*) FILTER (event_id % 23 <> 0) AS un,
    min(ts) FILTER (event_id % 23 <> 0) AS a, max(ts) FILTER (event_id % 23 <> 0) AS b, count(*) FILTER (user_id % 19 = 0 AND event_type = 'error') AS hidden FROM events GROUP BY user_id),
  s1 AS (SELECT *, {hours('a', 'b')} AS span_h FROM s0), s2 AS (SELECT *, CASE WHEN items < 2 THEN 'too few items' WHEN un < 2 THEN 'too few unpinned items' WHEN span_h <= 0 THEN 'bulk upload' ELSE 'ok' END AS status FROM s1),
  s3 AS (SELECT *, CASE WHEN status = 'ok' THEN (un - 1) / span_h END AS rate FROM s2),
  sc AS (SELECT owner, status, items, pinned, span_h, rate * 24 AS per_day, 12 / rate AS hours_in_grid, rate * 72 AS expected_new, least(12 / rate / 3, 24) * 0.5 AS predicted_readings, hidden FROM s3),
  sv AS (SELECT *, CASE WHEN status <> 'ok' THEN NULL WHEN hidden > 0 THEN 'REJECT' WHEN round(predicted_readings, 1) < 5 THEN 'REJECT' WHEN round(expected_new, 1) < 3 THEN 'REJECT'
    WHEN round(predicted_readings, 1) >= 10 AND round(expected_new, 1) >= 6 THEN 'STRONG' ELSE 'OK' END AS verdict FROM sc)"""


@query("screen_accounts", f"WITH {SCREEN} SELECT owner, status, items, pinned, {r('~span_h, ~per_day, ~hours_in_grid, ~expected_new, ~predicted_readings')}, verdict FROM sv")
def screen_accounts(spark, sf):
    return FR.screen_accounts(items(spark, sf), 3.0, 72.0)


@query("best_accounts", f"WITH {SCREEN} SELECT owner, verdict, {r('~predicted_readings')} FROM sv WHERE verdict IN ('STRONG', 'OK') ORDER BY sv.predicted_readings DESC, owner LIMIT 10")
def best_accounts(spark, sf):
    return FR.best_accounts(FR.screen_accounts(items(spark, sf), 3.0, 72.0), 10).select("owner", "verdict", "predicted_readings")

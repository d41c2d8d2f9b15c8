"""Decay labels, velocities, curves."""

from dataclasses import replace
from math import log

from pyspark.sql import functions as F

from checks.registry import query, r
from checks.views_sql import (EVENT_PANEL, LABEL_COLS, PART_PANEL, WEEKLY_PANEL, label_ctes, value_at_ctes)
from ebbtide.functions import scalars as S
from ebbtide.operators import labels as L
from ebbtide.operators import series
from ebbtide.operators.skew import followers, running
from ebbtide.plans.views import PANEL, event_panel, part_panel, weekly_panel


@query("decay_label", f"WITH {EVENT_PANEL}, {label_ctes()} SELECT {r(LABEL_COLS)} FROM lab")
def decay_label(spark, sf):
    return L.decay_label(event_panel(spark, sf), PANEL, seq="seq")


@query("decay_label_equal_ages", f"WITH {PART_PANEL}, {label_ctes()} SELECT {r(LABEL_COLS)} FROM lab")
def decay_label_equal_ages(spark, sf):
    return L.decay_label(part_panel(spark, sf), PANEL, seq="seq")


STRICT = replace(PANEL, frac=0.2, sustain=3, min_intervals=3, skip_first=True)


@query("decay_label_sustain3_skip_first",
       f"WITH {EVENT_PANEL}, {label_ctes(frac=0.2, sustain=3, min_intervals=3, skip_first=True)} "
       f"SELECT {r(LABEL_COLS)} FROM lab")
def decay_label_sustain3(spark, sf):
    return L.decay_label(event_panel(spark, sf), STRICT, seq="seq")


FRACS = (0.02, 0.05, 0.10)


@query("decay_label_sweep", f"WITH {WEEKLY_PANEL}, " + ", ".join(
    label_ctes(frac=f, out=f"lab{i}") for i, f in enumerate(FRACS)) + " " + " UNION ALL ".join(
    f"SELECT round({f}::DOUBLE, 6) AS frac, {r(LABEL_COLS)} FROM lab{i}" for i, f in enumerate(FRACS)))
def decay_label_sweep(spark, sf):
    return L.decay_label_sweep(weekly_panel(spark, sf), list(FRACS), PANEL, seq="seq")


@query("velocity_summary", f"""WITH {EVENT_PANEL}, a AS (SELECT *,
  CASE WHEN age_hours > lag(age_hours) OVER e THEN (value - lag(value) OVER e) / (age_hours - lag(age_hours) OVER e) END AS vel
  FROM p WINDOW e AS (PARTITION BY entity ORDER BY age_hours)),
  b AS (SELECT entity, count(*) AS n_obs, max(age_hours) AS max_age, max(vel) AS peak_velocity, avg(vel) AS mean_velocity,
  arg_max(value, age_hours) AS final_value FROM a GROUP BY entity)
  SELECT {r('entity, #n_obs, ~max_age, ~peak_velocity, ~mean_velocity, ~final_value')} FROM b""")
def velocity_summary(spark, sf):
    return series.velocity_summary(event_panel(spark, sf))


@query("running_maximum_clamp", f"""WITH {EVENT_PANEL}, {label_ctes()}
  SELECT entity, count(*) AS readings, CAST(sum(CASE WHEN rep THEN 1 ELSE 0 END) AS BIGINT) AS repairs,
  round(sum(cl - value), 6) + 0.0 AS lifted FROM lab_c GROUP BY entity""")
def running_maximum_clamp(spark, sf):
    g = series.clamped(series.collapse_equal_ages(
        series.by_entity(event_panel(spark, sf), extra=("seq",)), seq="seq"))
    return g.df.groupBy("entity").agg(
        F.count(F.lit(1)).alias("readings"), F.sum(F.col("repaired").cast("int")).alias("repairs"),
        F.sum(F.col("clamped") - F.col("value")).alias("lifted"))


@query("interval_velocity", f"""WITH {PART_PANEL}, {label_ctes()}
  SELECT entity, {r('~age, ~vel')} FROM lab_c WHERE vel IS NOT NULL""")
def interval_velocity(spark, sf):
    g = L.intervals(part_panel(spark, sf), PANEL, seq="seq")
    return g.df.filter(F.col("velocity").isNotNull()).select(
        "entity", F.col("age_hours").alias("age"), F.col("velocity").alias("vel"))


@query("sustain_window", f"""WITH {EVENT_PANEL}, {label_ctes(sustain=3)}
  SELECT entity, {r('~age')}, round(greatest(vel, v1, v2), 6) + 0.0 AS slowest_run FROM lab_d
  WHERE vel IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL""")
def sustain_window(spark, sf):
    g = L.intervals(event_panel(spark, sf), replace(PANEL, sustain=3), seq="seq")
    return g.df.filter(F.col("sustained").isNotNull()).select(
        "entity", F.col("age_hours").alias("age"), F.col("sustained").alias("slowest_run"))


@query("entity_peak", f"""WITH {WEEKLY_PANEL}, {label_ctes()} SELECT entity, round(max(peak), 6) + 0.0 AS peak,
  round(min(CASE WHEN vel = peak THEN age END), 6) AS peak_at FROM lab_d GROUP BY entity""")
def entity_peak(spark, sf):
    g = L.intervals(weekly_panel(spark, sf), PANEL, seq="seq")
    return g.df.groupBy("entity").agg(
        F.max("peak").alias("peak"),
        F.min(F.when(F.col("velocity") == F.col("peak"), F.col("age_hours"))).alias("peak_at"))


@query("curve_points", f"""WITH {EVENT_PANEL}, {label_ctes()}, c AS (SELECT entity, age AS age_hours, cl AS clamped,
  vel AS velocity, CASE WHEN peak > 0 THEN greatest(vel, 0) / peak END AS share0, peak * 0.05::DOUBLE AS threshold FROM lab_d)
  SELECT entity, {r('~age_hours, ~clamped, ~velocity')},
  CASE WHEN threshold > 0 THEN round(coalesce(share0, 0), 6) + 0.0 END AS speed_share, {r('~threshold')} FROM c""")
def curve_points(spark, sf):
    return L.curve_points(event_panel(spark, sf), PANEL, seq="seq")


@query("raw_curve", f"""WITH {EVENT_PANEL} SELECT entity, round(age_hours, 6) AS age_hours, round(value, 6) + 0.0 AS value,
  round((value - lag(value) OVER e) / nullif(age_hours - lag(age_hours) OVER e, 0), 6) + 0.0 AS velocity
  FROM p WHERE value IS NOT NULL WINDOW e AS (PARTITION BY entity ORDER BY age_hours)""")
def raw_curve(spark, sf):
    """Drops of a counter show as negative speeds here; the label's view lifts them."""
    return L.raw_curve(event_panel(spark, sf))


@query("curve_notes", f"""WITH {EVENT_PANEL}, {label_ctes()},
  f AS (SELECT entity, min(age_hours) AS first_age FROM p WHERE value IS NOT NULL GROUP BY entity)
  SELECT entity, CASE WHEN monotonicity_repairs > 0 THEN CAST(monotonicity_repairs AS BIGINT) END AS corrections,
  CASE WHEN first_age > 24 THEN round(first_age, 6) END AS late_first_reading FROM lab JOIN f USING (entity)""")
def curve_notes(spark, sf):
    p = event_panel(spark, sf)
    return L.curve_notes(p, L.decay_label(p, PANEL, seq="seq"), first_mark=24.0)


@query("life_status", f"""WITH {EVENT_PANEL}, {label_ctes()}, s AS (SELECT CASE WHEN exclude_reason IS NOT NULL THEN 'not enough observations'
  WHEN event_observed THEN 'died' ELSE 'alive' END AS status, t_death, last_observed_hours FROM lab)
  SELECT status, count(*) AS entities FROM s GROUP BY status""")
def life_status(spark, sf):
    lab = L.decay_label(event_panel(spark, sf), PANEL, seq="seq")
    s = lab.select(S.life_status("event_observed", "t_death", "last_observed_hours", "exclude_reason").alias("s"))
    status = F.when(F.col("s").startswith("not"), F.col("s")).otherwise(F.split("s", " ")[0])
    return s.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("entities"))


def saturation_sql(grid: int = 48, rounds: int = 3, target: float = PANEL.saturation_target) -> str:
    """The grid search over label_ctes' clamped readings: a cross product of readings and grid, three times over."""
    first = "SELECT *, ln(1e-6::DOUBLE) AS lo, ln(10::DOUBLE) AS hi FROM s"
    out = ["s AS (SELECT entity, age AS t, cl AS v, count(*) OVER e AS n, max(cl) OVER e AS top, sum(cl * cl) OVER e AS cc FROM lab_c "
           "WINDOW e AS (PARTITION BY entity) QUALIFY n >= 3 AND top > 0)"]
    for j in range(rounds):
        src = first if j == 0 else f"SELECT s.*, b.lo, b.hi FROM s JOIN b{j - 1} b USING (entity)"
        out.append(f"""g{j} AS (SELECT entity, i, any_value(lo) + (any_value(hi) - any_value(lo)) / {grid - 1} * i AS log_k, (any_value(hi) - any_value(lo)) / {grid - 1} AS step,
  any_value(top) AS top, any_value(cc) AS cc, sum(v * f) AS cf, sum(f * f) AS ff
  FROM (SELECT *, 1 - exp(-exp(lo + (hi - lo) / {grid - 1} * i) * t) AS f FROM ({src}), (SELECT unnest(generate_series(0, {grid - 1})) AS i)) GROUP BY entity, i),
a{j} AS (SELECT *, greatest(least(cf / ff, top * 100), top * 0.5) AS a FROM g{j} WHERE ff > 0),
b{j} AS (SELECT entity, log_k, a, greatest(log_k - step, ln(1e-6::DOUBLE)) AS lo, least(log_k + step, ln(10::DOUBLE)) AS hi FROM a{j}
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY cc - 2 * a * cf + a * a * ff, log_k) = 1)""")
    return ", ".join(out) + f""" SELECT entity, round({-log(1 - target)!r} / exp(log_k), 6) AS t_saturation, round(a, 6) AS fitted_A, round(exp(log_k), 6) AS fitted_k FROM b{rounds - 1}"""


@query("saturation_fit", f"WITH {EVENT_PANEL}, {label_ctes()}, {saturation_sql()}")
def saturation_fit(spark, sf):
    return L.saturation_fit(event_panel(spark, sf), PANEL, seq="seq").drop("sse")


@query("interpolate_at_marks", f"WITH {WEEKLY_PANEL}, {value_at_ctes((4.0, 12.0, 24.0, 48.0, 96.0))} "
       f"SELECT {r('entity, #n_readings, ~first_age, ~last_age, ~v0, ~v1, ~v2, ~v3, ~v4')} FROM va")
def interpolate_at_marks(spark, sf):
    return series.value_at(weekly_panel(spark, sf), [4.0, 12.0, 24.0, 48.0, 96.0]).drop("n_rows", "n_values")


@query("last_reading_at_landmark", f"""WITH {WEEKLY_PANEL}, e AS (SELECT * FROM p WHERE age_hours <= 28)
  SELECT entity, arg_max(views, age_hours) AS views, arg_max(likes, CASE WHEN likes IS NOT NULL THEN age_hours END) AS likes,
  arg_max(comments, age_hours) AS comments FROM e GROUP BY entity""")
def last_reading_at_landmark(spark, sf):
    return series.last_at_or_before(weekly_panel(spark, sf), 28.0, ["views", "likes", "comments"])


@query("asof_join", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
    TIMESTAMP '2024-01-01' + CAST(o_orderkey * 7919 % 2592000 AS BIGINT) * INTERVAL 1 SECOND AS ts, o_custkey % 150 AS user_id FROM orders)
  SELECT o_orderkey, round(e.value, 6) AS asof_value, e.event_type AS asof_event_type
  FROM o ASOF LEFT JOIN (SELECT user_id, max(ts) AS ts, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type
     FROM events GROUP BY user_id, ts) e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def asof_join(spark, sf):
    from ebbtide.plans.views import table
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 150).alias("user_id"),
        F.timestamp_add("SECOND", (F.col("o_orderkey") * 7919 % 2592000).cast("int"),
                        F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    return series.asof_join(o, e, "user_id", "ts", ["value", "event_type"]).drop("user_id", "ts")


@query("hot_entity_scan", """WITH a AS (SELECT event_type AS entity, event_id AS seq, ts, value,
    lag(value) OVER w AS prev, lead(value) OVER w AS nxt, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
  SELECT entity, seq, total, round(prev, 6) AS prev, round(nxt, 6) AS nxt FROM a""")
def hot_entity_scan(spark, sf):
    """Five entities hold the whole table: every one is cut into pieces and scanned across them."""
    from ebbtide.operators.skew import previous, split_hot
    from ebbtide.plans.views import table
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("entity"), F.col("event_id").alias("seq"), "value",
        F.round(F.col("value") * 100).cast("bigint").alias("c"))
    g = split_hot(e, ["entity"], "seq", max_rows=200)
    g = running(g, ["seq"], {"total": ("sum", "c")})
    g = previous(g, "seq", {"prev": "value"})
    g = followers(g, "seq", "value", 1, "_n")
    return g.df.select("entity", "seq", "total", "prev", F.get("_n", F.lit(0)).alias("nxt"))

"""Panel state, due lists, coverage, outages, volume, alarms."""

from pyspark.sql import functions as F

from checks.registry import query, r
from checks.views_sql import EVENT_PANEL, WEEKLY_ENTITIES, WEEKLY_PANEL, hours, label_ctes
from ebbtide.operators import monitor as M
from ebbtide.operators import panel
from ebbtide.plans.views import NOW, PANEL, event_panel, table, weekly_entities, weekly_panel

MID = "2024-01-17 06:00:00"
OPENS = PANEL.first_mark_opens
SCHEDULE = ", ".join(f"({m!r}::DOUBLE, {(list(PANEL.schedule) + [None])[i + 1]!r})".replace("None", "NULL")
                     for i, m in enumerate(PANEL.schedule))
PASSED = " + ".join(f"CASE WHEN age_now >= {m!r} THEN 1 ELSE 0 END" for m in PANEL.schedule)

STATE = f"""{WEEKLY_PANEL}, {WEEKLY_ENTITIES}, ps AS (SELECT en.entity, en.owner, en.source, en.published_at,
  coalesce(n, 0) AS reading_count, coalesce(sc, 0) AS scheduled_count, last_reading_at FROM en LEFT JOIN
  (SELECT entity, count(*) AS n, count(*) FILTER (age_hours >= {OPENS}) AS sc, max(reading_ts) AS last_reading_at
   FROM p WHERE reading_ts <= TIMESTAMP '{MID}' GROUP BY entity) USING (entity)),
  sch AS (SELECT *, {hours('published_at', f"TIMESTAMP '{MID}'")} AS age_now FROM ps),
  sd AS (SELECT *, {PASSED} AS marks_passed, age_now BETWEEN 0 AND {PANEL.max_track} AS active FROM sch)"""


def seen_by(spark, sf, now=MID):
    return weekly_panel(spark, sf).filter(F.col("reading_ts") <= F.lit(now).cast("timestamp"))


def state(spark, sf):
    return panel.panel_state(weekly_entities(spark, sf), seen_by(spark, sf), PANEL)


@query("panel_state", f"WITH {STATE} SELECT entity, owner, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, "
       f"{r('#reading_count, #scheduled_count')}, strftime(last_reading_at, '%Y-%m-%d %H:%M:%S') AS last_reading_at FROM ps")
def panel_state(spark, sf):
    return state(spark, sf)


@query("due_list", f"WITH {STATE} SELECT entity, {r('~age_now, #marks_passed, #scheduled_count')} FROM sd "
       "WHERE active AND scheduled_count < marks_passed")
def due_list(spark, sf):
    return panel.due_list(state(spark, sf), MID, PANEL).select("entity", "age_now", "marks_passed", "scheduled_count")


@query("panel_stats", f"""WITH {STATE} SELECT count(*) AS entities_total, count(*) FILTER (active) AS entities_active,
  count(*) FILTER (active AND scheduled_count < marks_passed) AS entities_due, CAST(sum(reading_count) AS BIGINT) AS readings_total,
  round(avg(reading_count), 6) AS readings_per_entity FROM sd""")
def panel_stats(spark, sf):
    return panel.panel_stats(state(spark, sf), MID, PANEL)


@query("label_summary", f"""WITH {EVENT_PANEL}, {label_ctes()} SELECT count(*) AS entities,
  count(*) FILTER (exclude_reason IS NULL) AS labelled, count(*) FILTER (event_observed) AS events,
  count(*) FILTER (exclude_reason IS NULL AND NOT event_observed) AS censored, CAST(sum(monotonicity_repairs) AS BIGINT) AS repairs FROM lab""")
def label_summary(spark, sf):
    from ebbtide.operators.labels import decay_label
    return panel.label_summary(decay_label(event_panel(spark, sf), PANEL, seq="seq"))


TOL = PANEL.tolerance


def coverage_ctes(now: str = NOW) -> str:
    return f"""{WEEKLY_PANEL}, {WEEKLY_ENTITIES}, m(mark, nxt) AS (VALUES {SCHEDULE}),
  g AS (SELECT entity, mark, nxt FROM en, m WHERE mark <= {hours('published_at', f"TIMESTAMP '{now}'")}),
  h AS (SELECT g.entity, g.mark, arg_min(age_hours, (abs(age_hours - mark), age_hours)) FILTER (abs(age_hours - mark) <= {TOL}) AS near,
    min(age_hours) FILTER (age_hours > mark AND age_hours < least(mark + {6 * TOL}, coalesce(nxt - {TOL}, 1e300))) AS lt
    FROM g LEFT JOIN p ON p.entity = g.entity GROUP BY g.entity, g.mark, g.nxt),
  cv AS (SELECT entity, mark, near IS NOT NULL AS on_time, near IS NULL AND lt IS NOT NULL AS late,
    near IS NOT NULL OR lt IS NOT NULL AS hit, coalesce(near, lt) - mark AS lateness FROM h),
  pe AS (SELECT entity, count(*) AS expected, count(*) FILTER (hit) AS hits, avg(hit::INT) AS completeness,
    avg(on_time::INT) AS strict_completeness FROM cv GROUP BY entity)"""


def coverage(spark, sf):
    return M.mark_coverage(weekly_entities(spark, sf), weekly_panel(spark, sf), NOW, PANEL)


@query("mark_coverage", f"WITH {coverage_ctes()} SELECT entity, {r('~mark, ~lateness')}, on_time, late, hit FROM cv")
def mark_coverage(spark, sf):
    return coverage(spark, sf)


@query("completeness_by_entity", f"WITH {coverage_ctes()} SELECT entity, {r('#expected, #hits, ~completeness, ~strict_completeness')} FROM pe")
def completeness_by_entity(spark, sf):
    return M.completeness_by_entity(coverage(spark, sf))


@query("completeness", f"""WITH {coverage_ctes()} SELECT count(*) AS entities_evaluated, round(avg(completeness), 6) AS mean_completeness,
  round(avg(strict_completeness), 6) AS mean_strict_completeness, count(*) FILTER (completeness < 0.8) AS entities_below_80pct,
  (SELECT round(avg(lateness), 6) FROM cv) AS mean_lateness_hours, (SELECT round(max(lateness), 6) FROM cv) AS max_lateness_hours FROM pe""")
def completeness(spark, sf):
    return M.completeness(coverage(spark, sf))


@query("counts_by_mark", f"""WITH {coverage_ctes()} SELECT round(m.mark, 6) AS mark, count(entity) AS expected,
  count(*) FILTER (coalesce(hit, false)) AS hits, count(*) FILTER (coalesce(on_time, false)) AS on_time,
  count(*) FILTER (coalesce(late, false)) AS late FROM m LEFT JOIN cv ON cv.mark = m.mark GROUP BY m.mark""")
def counts_by_mark(spark, sf):
    return M.counts_by_mark(coverage(spark, sf), PANEL)


@query("coverage_by_mark", f"""WITH {WEEKLY_PANEL}, m(mark, nxt) AS (VALUES {SCHEDULE}),
  h AS (SELECT entity, mark, max((abs(age_hours - mark) <= {TOL})::INT) AS hit FROM p, m GROUP BY entity, mark)
  SELECT round(mark, 6) AS mark, round(avg(hit), 6) AS on_time FROM h GROUP BY mark""")
def coverage_by_mark(spark, sf):
    return M.coverage_by_mark(weekly_entities(spark, sf), weekly_panel(spark, sf), PANEL)


# One user's activity leaves gaps; the whole table's does not.
GAPPY = "SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'purchase' OR event_type = 'view'"


def purchases(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "view")).select(
        F.col("ts").cast("timestamp").alias("reading_ts"), F.col("user_id").cast("string").alias("entity"))


@query("outages", f"""WITH h AS (SELECT DISTINCT hour FROM ({GAPPY})), g AS (SELECT hour, lag(hour) OVER (ORDER BY hour) AS prev FROM h)
  SELECT strftime(prev + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, CAST(date_diff('hour', prev, hour) - 1 AS BIGINT) AS hours_missing
  FROM g WHERE date_diff('hour', prev, hour) - 1 > 0""")
def outages(spark, sf):
    return M.outages(purchases(spark, sf), max_missed=0)


@query("outages_per_entity_day", """WITH h AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
  g AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM h)
  SELECT user_id, strftime(prev + INTERVAL 1 DAY, '%Y-%m-%d') AS start, CAST(date_diff('day', prev, day) - 1 AS BIGINT) AS days_missing
  FROM g WHERE date_diff('day', prev, day) - 1 > 0""")
def outages_per_entity_day(spark, sf):
    from ebbtide.operators.skew import previous, split_hot
    d = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = previous(split_hot(d.withColumn("_d", F.unix_date("day")), ["user_id"], "_d"), "_d", {"prev": "_d"})
    missing = F.col("_d") - F.col("prev") - 1
    return g.df.withColumn("days_missing", missing).filter(F.col("days_missing") > 0).select(
        "user_id", F.date_from_unix_date(F.col("prev") + 1).alias("start"), "days_missing")


@query("silence", f"""WITH l AS (SELECT date_trunc('hour', max(ts)) AS last FROM events)
  SELECT strftime(last, '%Y-%m-%d %H:%M:%S') AS last_data_at, round({hours('last', f"TIMESTAMP '{NOW}'")}, 6) AS hours_since_last_data FROM l""")
def silence(spark, sf):
    return M.silence(weekly_panel(spark, sf), NOW)


@query("health", f"""WITH {coverage_ctes()}, gaps AS (SELECT count(*) AS n FROM (SELECT hour, lag(hour) OVER (ORDER BY hour) AS prev
    FROM (SELECT DISTINCT date_trunc('hour', reading_ts) AS hour FROM p)) WHERE date_diff('hour', prev, hour) - 1 > 2),
  c AS (SELECT count(*) AS ev, avg(completeness) AS mc FROM pe), s AS (SELECT {hours("date_trunc('hour', max(reading_ts))", f"TIMESTAMP '{NOW}'")} AS quiet FROM p)
  SELECT (SELECT count(*) FROM en) AS entities_total, ev AS entities_evaluated, round(mc, 6) AS mean_completeness, n AS n_outages,
  round(quiet, 6) AS hours_since_last_data, concat_ws('; ', CASE WHEN n > 0 THEN n || ' outage(s)' END,
  CASE WHEN quiet > 3 THEN 'collection stopped' END, CASE WHEN ev >= 50 AND mc < 0.5 THEN 'completeness collapsed' END) AS problems FROM c, s, gaps""")
def health(spark, sf):
    d = M.health(weekly_entities(spark, sf), weekly_panel(spark, sf), NOW, PANEL)
    return d.select("entities_total", "entities_evaluated", "mean_completeness", "n_outages", "hours_since_last_data",
                    F.concat_ws("; ", "problems").alias("problems"))


@query("daily_volume", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, d AS (SELECT unnest(generate_series(min(CAST(reading_ts AS DATE)), max(CAST(reading_ts AS DATE)), INTERVAL 1 DAY)) AS day FROM p),
  a AS (SELECT CAST(reading_ts AS DATE) AS day, count(*) AS n FROM p GROUP BY 1), b AS (SELECT CAST(published_at AS DATE) AS day, count(*) AS n FROM en GROUP BY 1)
  SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(a.n, 0) AS readings, coalesce(b.n, 0) AS new_entities
  FROM d LEFT JOIN a ON a.day = d.day LEFT JOIN b ON b.day = d.day""")
def daily_volume(spark, sf):
    return M.daily_volume(weekly_panel(spark, sf), weekly_entities(spark, sf))


def cycles(spark, sf):
    """One run log per order, in the nested shape of a cycle log."""
    o = table(spark, sf, "orders")
    units = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    return o.select(F.col("o_orderdate").cast("timestamp").alias("started_at"),
                    (F.col("o_orderstatus") == "F").alias("quota_exceeded"),
                    F.struct(units.alias("units_spent"),
                             F.create_map(F.col("o_orderpriority"), units).alias("by_endpoint")).alias("quota"))


@query("spend_by_endpoint", """SELECT o_orderpriority AS endpoint, CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS units,
  count(*) AS runs FROM orders GROUP BY 1""")
def spend_by_endpoint(spark, sf):
    return M.spend_by_endpoint(cycles(spark, sf))


@query("spend_per_day", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS units,
  count(*) AS runs FROM orders GROUP BY 1""")
def spend_per_day(spark, sf):
    return M.spend_per_day(cycles(spark, sf))


@query("spend_summary", """WITH u AS (SELECT CAST(floor(o_totalprice / 1000) AS BIGINT) AS u FROM orders) SELECT count(*) AS runs,
  round(avg(u), 6) AS mean_units, min(u) AS min_units, max(u) AS max_units, round(median(u), 6) AS median_units FROM u""")
def spend_summary(spark, sf):
    return M.spend_summary(cycles(spark, sf))


@query("empty_rounds", """WITH a AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 0 ELSE 1 END AS called,
    CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS seen, conv_id * 1000 + turn AS k FROM conversations)
  SELECT count(*) AS empty_rounds FROM a WHERE k > coalesce((SELECT max(k) FROM a WHERE called <= 0 OR seen > 0), -1)""")
def empty_rounds(spark, sf):
    a = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("started_at"), F.lit(False).alias("dry_run"),
        F.when(F.length("text") % 5 == 0, 0).otherwise(1).alias("accounts_called"),
        F.when(F.col("role") == "user", 0).otherwise(F.length("text")).alias("posts_seen"))
    return M.empty_rounds(a)


@query("equivalence_check", """SELECT count(DISTINCT user_id || event_type) AS rows, CAST(0 AS BIGINT) AS unmatched,
  CAST(0 AS BIGINT) AS different, true AS agrees FROM events WHERE ts >= TIMESTAMP '2024-01-01' + (user_id % 24) * INTERVAL 1 HOUR""")
def equivalence_check(spark, sf):
    """The benchmark job against an independent formulation of it."""
    from ebbtide.operators.series import velocity_summary
    p = event_panel(spark, sf)
    p.createOrReplaceTempView("_panel")
    other = spark.sql("""SELECT entity, count(age_hours) AS n_obs, max(age_hours) AS max_age, max(v) AS peak_velocity,
        avg(v) AS mean_velocity, max_by(value, age_hours) AS final_value FROM (SELECT *, CASE WHEN age_hours > pa THEN (value - pv) / (age_hours - pa) END AS v
        FROM (SELECT *, lag(age_hours) OVER (PARTITION BY entity ORDER BY age_hours) AS pa,
              lag(value) OVER (PARTITION BY entity ORDER BY age_hours) AS pv FROM _panel)) GROUP BY entity""")
    return M.equivalence_check(velocity_summary(p), other, ["entity"])

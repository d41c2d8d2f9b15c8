"""Streams run to the end of the given tables; results equal the batch answers."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.bronze import fresh_folder
from checks.registry import query, r
from checks.views_sql import EVENT_PANEL, LABEL_COLS, WEEKLY_PANEL, hours, label_ctes
from ebbtide.functions import scalars as S
from ebbtide.plans.views import PANEL, event_panel, weekly_panel
from ebbtide.session import cut_lineage
from ebbtide.sources.bronze import write_bronze
from ebbtide.streaming import streams as T

START = "2024-01-01"


def events(spark, sf):
    """The event table as a stream of readings."""
    return as_readings(T.stream_table(spark, f"{sf}/events.parquet"))


def events_table(spark, sf):
    return as_readings(spark.read.parquet(f"{sf}/events.parquet"))


def as_readings(e):
    pub = F.timestamp_add("HOUR", (F.col("user_id") % 24).cast("int"), F.lit(START).cast("timestamp"))
    return e.select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("entity"),
                    F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("source"),
                    F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("reading_ts"),
                    pub.alias("published_at"), S.hours_between(pub, F.col("ts").cast("timestamp")).alias("age_hours"), "value")


FILES = 4
FILE_ROWS = 500_000     # rows of a file, about; a delivery of more is several files of one batch


def deliver(spark, name, rows, ts="reading_ts", key="seq", shuffled=False):
    """`rows` as deliveries in order of `ts`, streamed one per batch; the second one comes once more at the end.

    If `shuffled`, one row in eleven comes a delivery later than its time says. Every delivery is as many files.
    """
    folder = fresh_folder(spark, name)
    at = F.unix_micros(F.col(ts).cast("timestamp")) if dict(rows.dtypes)[ts].startswith("timestamp") else F.col(ts).cast("long")
    rows = cut_lineage(rows)
    low, high, n = rows.select(F.min(at), F.max(at), F.count(F.lit(1))).first()
    width, files = (high - low) // FILES + 1, max(1, -(-n // (FILES * FILE_ROWS)))
    file = F.floor((at - low) / width) + (F.when(F.col(key) % 11 == 0, 1).otherwise(0) if shuffled else F.lit(0))
    for k, i in enumerate([*range(FILES + shuffled), 1], 1):
        part = rows.filter(file == i)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
        for _ in range(k * files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) if files > 1 else 0):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)     # empty parts are not written
    return T.stream_table(spark, folder, files_per_trigger=files)


def delivered(src, at, key="seq", delay_hours=None, shuffled=False):
    """The same on the SQL side: table `dl` with `file`, and `late` by the watermark's rule."""
    late = (f"coalesce(us <= newest - {int(delay_hours * 3_600_000_000)}, false)" if delay_hours else "false")
    return f"""d0 AS (SELECT *, {at} AS us FROM {src}), d1 AS (SELECT *, min(us) OVER () AS low, (max(us) OVER () - min(us) OVER ()) // {FILES} + 1 AS width FROM d0),
  d2 AS (SELECT *, (us - low) // width {f"+ CASE WHEN {key} % 11 = 0 THEN 1 ELSE 0 END" if shuffled else ""} AS file FROM d1),
  d3 AS (SELECT * FROM d2 UNION ALL SELECT * REPLACE ({FILES + shuffled} AS file) FROM d2 WHERE file = 1),
  d4 AS (SELECT file, max(max(us)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 AS newest FROM d3 GROUP BY file),
  dl AS (SELECT d3.*, {late} AS late FROM d3 JOIN d4 USING (file))"""


EV = f"""e AS (SELECT CAST(user_id AS VARCHAR) || '_' || event_type AS entity, CAST(user_id AS VARCHAR) AS owner, event_type AS source, event_id AS seq, ts AS reading_ts,
  TIMESTAMP '2024-01-01' + (user_id % 24) * INTERVAL 1 HOUR AS published_at, {hours("(TIMESTAMP '2024-01-01' + (user_id % 24) * INTERVAL 1 HOUR)", 'ts')} AS age_hours, value FROM events)"""


@query("stream_dedupe", "SELECT count(*) AS rows, count(DISTINCT user_id || event_type) AS entities, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def stream_dedupe(spark, sf):
    """Every reading delivered twice; one copy of each is kept."""
    e = events(spark, sf)
    twice = e.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy"))
    out = T.available_now(T.stream_dedupe(twice, ["entity", "reading_ts"], delay="60 days"), fresh_folder(spark, "dedupe"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.sum("seq").alias("ids"))


@query("stream_landed_readings", f"""WITH {WEEKLY_PANEL} SELECT source AS platform, count(*) AS readings, count(DISTINCT entity) AS entities, CAST(sum(views) AS BIGINT) AS views
  FROM p GROUP BY 1""")
def stream_landed_readings(spark, sf):
    """Readings landed as JSON lines in two deliveries, then streamed from the landing zone a file at a time."""
    p = weekly_panel(spark, sf).select(
        F.col("entity").alias("post_id"), F.date_format("reading_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("snapshot_ts"), "views",
        F.col("source").alias("platform"), F.to_date("reading_ts").alias("dt"), F.lit("2024-02-01T00:00:00Z").alias("_ingested_at"))
    root, stage = fresh_folder(spark, "landing"), fresh_folder(spark, "landing-stage")
    write_bronze(p, root, "snapshots", stage)
    write_bronze(p.filter(F.dayofmonth("dt") > 20), root, "snapshots", stage)
    out = T.available_now(T.stream_readings(spark, root, files_per_trigger=20), fresh_folder(spark, "landed"))
    return out.groupBy("platform").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("post_id").alias("entities"), F.sum("views").alias("views"))


@query("stream_merge", "SELECT count(*) AS rows, round(sum(value), 4) AS total FROM events")
def stream_merge(spark, sf):
    e = events(spark, sf).select("entity", "reading_ts", "value", F.lit("2024-02-01").alias("_ingested_at"),
                                 F.to_date("reading_ts").alias("dt"))
    folder = fresh_folder(spark, "merge")
    stale = e.withColumns({"value": F.lit(0.0), "_ingested_at": F.lit("2024-01-01")})
    out = T.stream_merge(e.unionByName(stale), f"{folder}/table", folder, ("entity", "reading_ts"), ("dt",))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_owner_cap", f"""WITH q AS (SELECT o_orderkey, o_custkey % 7 AS owner, o_orderdate FROM orders),
  {delivered("q", "epoch_us(CAST(o_orderdate AS TIMESTAMP))", "o_orderkey", 168, True)},
  f AS (SELECT owner, o_orderkey, CAST(o_orderdate AS DATE) AS day, min(file) AS file, min(o_orderdate) AS o_orderdate FROM dl WHERE NOT late GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY owner, day ORDER BY file, o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn FROM f)
  SELECT CAST(owner AS VARCHAR) AS owner, count(*) AS admitted, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o WHERE rn <= 2 GROUP BY owner""")
def stream_owner_cap(spark, sf):
    """Six batches, one of them a replay; orders that come more than a week behind are not admitted."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("entity"), (F.col("o_custkey") % 7).cast("string").alias("owner"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), "o_orderkey")
    s = deliver(spark, "cap-in", o, "published_at", "o_orderkey", shuffled=True).drop("o_orderkey")
    out = T.stream_owner_cap(s, fresh_folder(spark, "cap"), 2)
    return out.groupBy("owner").agg(F.count(F.lit(1)).alias("admitted"), F.sum(F.col("entity").cast("bigint")).alias("keys"))


@query("stream_panel_state", f"""WITH {EV}, {delivered("e", "epoch_us(reading_ts)", delay_hours=48, shuffled=True)}
  SELECT entity, count(*) AS reading_count, count(*) FILTER (age_hours >= {PANEL.first_mark_opens}) AS scheduled_count,
  strftime(max(reading_ts), '%Y-%m-%d %H:%M:%S') AS last_reading_at FROM dl WHERE NOT late GROUP BY entity""")
def stream_panel_state(spark, sf):
    s = deliver(spark, "panel-in", events_table(spark, sf), shuffled=True)
    out = T.available_now(T.stream_panel_state(s, PANEL, 48.0), fresh_folder(spark, "panel"), mode="update")
    return T.latest(out, ["entity"])


FINAL = "(SELECT max(us) // 1000 FROM d0) - {delay} > (epoch_us(published_at) + {track}) // 1000 AS final"


@query("stream_decay_label", f"""WITH {EVENT_PANEL}, d0 AS (SELECT *, epoch_us(reading_ts) AS us FROM p), {label_ctes()},
  pub AS (SELECT entity, min(published_at) AS published_at FROM p GROUP BY entity)
  SELECT {r(LABEL_COLS)}, {FINAL.format(delay=int(PANEL.max_track * 3_600_000), track=int(PANEL.max_track * 3_600_000_000))} FROM lab JOIN pub USING (entity)""")
def stream_decay_label(spark, sf):
    """The event panel in five batches, the last one a replay."""
    s = deliver(spark, "labels-in", event_panel(spark, sf))
    return T.stream_decay_label(s, fresh_folder(spark, "labels"), PANEL, "seq")


WEEK = replace(PANEL, max_track=168.0, min_intervals=2, sustain=1)


@query("stream_label_finality", f"""WITH {WEEKLY_PANEL}, {delivered("p", "epoch_us(reading_ts)", delay_hours=36, shuffled=True)},
  k AS (SELECT * FROM dl WHERE NOT late AND age_hours <= {WEEK.max_track}), {label_ctes("k", sustain=1, min_intervals=2)},
  pub AS (SELECT entity, min(published_at) AS published_at FROM k GROUP BY entity)
  SELECT {r(LABEL_COLS)}, {FINAL.format(delay=36 * 3_600_000, track=int(WEEK.max_track * 3_600_000_000))} FROM lab JOIN pub USING (entity)""")
def stream_label_finality(spark, sf):
    """Weeks of users in six batches with rows out of order, rows too late and a replay: labels of past weeks become final."""
    s = deliver(spark, "weeks-in", weekly_panel(spark, sf), shuffled=True)
    return T.stream_decay_label(s, fresh_folder(spark, "weeks"), WEEK, "seq", delay_hours=36.0)


@query("stream_late_rows", f"""WITH {EV}, {delivered("e", "epoch_us(reading_ts)", delay_hours=48, shuffled=True)}
  SELECT late, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS ids, round(sum(value), 4) AS total FROM dl GROUP BY late""")
def stream_late_rows(spark, sf):
    """Both tables of the split; together they hold every delivered row once."""
    ok, late = T.stream_split_late(deliver(spark, "split-in", events_table(spark, sf), shuffled=True), fresh_folder(spark, "split"), 48.0)
    both = ok.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("late").agg(F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_lateness", f"""WITH {EV}, m AS (SELECT *, greatest({', '.join(f'CASE WHEN age_hours >= {m - PANEL.tolerance!r} THEN {m!r} END' for m in PANEL.schedule)})::DOUBLE AS mark FROM e)
  SELECT mark, count(*) AS readings, count(*) FILTER (age_hours - mark > {PANEL.tolerance}) AS late, round(avg(age_hours - mark), 6) AS lateness FROM m GROUP BY mark""")
def stream_lateness(spark, sf):
    out = T.available_now(T.with_lateness(events(spark, sf), PANEL), fresh_folder(spark, "late"))
    return out.groupBy("mark").agg(F.count(F.lit(1)).alias("readings"), F.count_if("late").alias("late"), F.avg("lateness").alias("lateness"))


@query("stream_daily_volume", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS readings FROM events GROUP BY 1")
def stream_daily_volume(spark, sf):
    out = T.available_now(T.volume_per(events(spark, sf)), fresh_folder(spark, "volume"), mode="update")
    return T.latest(out, ["start"]).select("start", "readings")


@query("stream_trailing_coverage", f"""WITH {EV}, m AS (SELECT *, greatest({', '.join(f'CASE WHEN age_hours >= {m - PANEL.tolerance!r} THEN {m!r} END' for m in PANEL.schedule)})::DOUBLE AS mark FROM e),
  w AS (SELECT *, unnest(generate_series(date_trunc('hour', reading_ts) - INTERVAL 11 HOUR, date_trunc('hour', reading_ts), INTERVAL 1 HOUR)) AS start FROM m)
  SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS readings, round(avg((mark IS NOT NULL AND age_hours - mark <= {PANEL.tolerance})::INT), 6) AS on_time FROM w GROUP BY start""")
def stream_trailing_coverage(spark, sf):
    out = T.available_now(T.trailing_coverage(events(spark, sf), PANEL), fresh_folder(spark, "trail"), mode="update")
    return T.latest(out, ["start"])


GAP = 6     # hours of quiet that make an outage of a user's activity


@query("stream_sessions", f"""WITH {EV}, o AS (SELECT *, owner AS who FROM e), {delivered("o", "epoch_us(reading_ts)", delay_hours=24, shuffled=True)},
  m AS (SELECT DISTINCT who, date_trunc('minute', reading_ts) AS minute FROM dl WHERE NOT late),
  g AS (SELECT *, lag(minute) OVER (PARTITION BY who ORDER BY minute) AS prev FROM m)
  SELECT who AS source, strftime(prev, '%Y-%m-%d %H:%M:%S') AS last_data_at, strftime(minute, '%Y-%m-%d %H:%M:%S') AS resumed_at,
  round({hours('prev', 'minute')}, 6) AS hours_quiet FROM g WHERE minute - prev >= INTERVAL {GAP} HOUR""")
def stream_sessions(spark, sf):
    """Outages of every user, from six batches with rows out of order; the open tail of a user closes no outage."""
    s = deliver(spark, "sessions-in", events_table(spark, sf), shuffled=True).withColumn("source", F.col("owner"))
    return T.outages_between(T.stream_sessions(s, fresh_folder(spark, "sessions"), GAP, delay_hours=24.0))


@query("stream_open_sessions", f"""WITH {EV}, m AS (SELECT DISTINCT owner, date_trunc('minute', reading_ts) AS minute FROM e),
  g AS (SELECT *, coalesce((minute - lag(minute) OVER w >= INTERVAL {GAP} HOUR)::INT, 0) AS new FROM m WINDOW w AS (PARTITION BY owner ORDER BY minute)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY minute) AS k FROM g)
  SELECT owner AS source, strftime(min(minute), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(minute), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS minutes,
  (SELECT max(epoch_ms(reading_ts)) FROM e) // 60000 - 1440 - epoch_ms(max(minute)) // 60000 >= {GAP * 60} AS closed FROM s GROUP BY owner, k""")
def stream_open_sessions(spark, sf):
    """Every stretch of activity, closed or still open; nothing is lost at the end."""
    s = deliver(spark, "open-in", events_table(spark, sf)).withColumn("source", F.col("owner"))
    return T.stream_sessions(s, fresh_folder(spark, "open"), GAP, delay_hours=24.0)


@query("stream_enrich", """SELECT c_mktsegment AS segment, count(*) AS readings FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1""")
def stream_enrich(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("owner"), F.col("c_mktsegment").alias("segment"))
    out = T.available_now(T.enrich(events(spark, sf), c), fresh_folder(spark, "enrich"))
    return out.groupBy("segment").agg(F.count(F.lit(1)).alias("readings"))


@query("stream_heartbeat", f"""SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_data_at, round({hours('max(ts)', "TIMESTAMP '2024-02-01'")}, 6) AS hours_silent,
  {hours('max(ts)', "TIMESTAMP '2024-02-01'")} > 3 AS stopped FROM events GROUP BY 1""")
def stream_heartbeat(spark, sf):
    return T.heartbeat(events(spark, sf), fresh_folder(spark, "beat"), lambda: "2024-02-01 00:00:00")


@query("stream_breaker", """WITH a AS (SELECT conv_id % 5 AS s, conv_id * 1000 + turn AS k, CASE WHEN length(text) % 7 = 0 THEN 0 ELSE 1 END AS called,
    CASE WHEN role = 'user' THEN 0 ELSE 1 END AS seen FROM conversations),
  l AS (SELECT s, max(k) FILTER (called <= 0 OR seen > 0) AS last FROM a GROUP BY s)
  SELECT CAST(a.s AS VARCHAR) AS source, count(DISTINCT k) AS attempts, count(DISTINCT k) FILTER (k > coalesce(last, -1)) AS empty_rounds,
  count(*) FILTER (k > coalesce(last, -1)) >= 1 AS tripped FROM a JOIN l USING (s) GROUP BY a.s""")
def stream_breaker(spark, sf):
    """Five batches of the attempt log, the last one a replay."""
    a = spark.read.parquet(f"{sf}/conversations.parquet").select(
        (F.col("conv_id") % 5).cast("string").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
        F.lit(False).alias("dry_run"), F.when(F.length("text") % 7 == 0, 0).otherwise(1).alias("accounts_called"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("posts_seen"))
    return T.breaker(deliver(spark, "breaker-in", a, "at", "at"), fresh_folder(spark, "breaker"), trip_at=1)

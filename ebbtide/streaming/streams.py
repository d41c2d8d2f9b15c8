"""Incremental versions: the same answers from files as they arrive.

Streams read appended files and stop when caught up (`available_now`). Results
go to tables under a folder all executors share, one sub-folder per micro-batch,
which a repeated batch overwrites; so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.sources.bronze import READINGS_SCHEMA, dedupe_last, is_file, kind_files, merge_partitions
from ebbtide.streaming.state import keyed_breaker, keyed_cap, keyed_labels, keyed_panel_state, keyed_sessions


# ---------------------------------------------------------------- sources and sinks
def stream_readings(spark: SparkSession, root: str, kind: str = "snapshots",
                    files_per_trigger: int | None = None) -> DataFrame:
    """Appended JSON-lines readings, with the file each record came from."""
    folder, pattern = kind_files(spark, root, kind)
    r = spark.readStream.schema(READINGS_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.option("basePath", folder).json(folder)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, with its own schema: that path alone, none with a like name."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if not is_file(spark, path):
        return r.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return r.option("pathGlobFilter", name).parquet(folder)


def available_now(df: DataFrame, folder: str, mode: str = "append",
                  each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream to the end of what is there; returns its result table.

    Each micro-batch overwrites its own `batch=<id>` folder. `each` may turn the
    batch into what is stored; it receives the batch and its id.
    """
    out = f"{folder}/out"

    def store(batch: DataFrame, i: int) -> None:
        rows = batch if each is None else each(batch, i)
        rows.write.mode("overwrite").parquet(f"{out}/batch={i}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(store).start())
    q.awaitTermination()
    return df.sparkSession.read.option("basePath", out).parquet(f"{out}/batch=*")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last stored row per key of an update-mode result."""
    return dedupe_last(table, keys, [F.desc("batch")]).drop("batch")


# ---------------------------------------------------------------- dedupe and merge
def stream_dedupe(readings: DataFrame, keys: list[str], ts: str = "reading_ts", delay: str = "2 days") -> DataFrame:
    """Natural-key dedupe inside the delay. Keeps the first copy; see `stream_merge` for corrections."""
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_merge(records: DataFrame, table: str, folder: str, keys: tuple[str, ...] | None, parts: tuple[str, ...],
                 ingested: str = "_ingested_at") -> DataFrame:
    """Fold fresher versions of known keys into a partitioned table, batch by batch.

    Only the partitions a batch touches are rewritten, and a repeated batch
    changes nothing, with keys or without.
    """
    def step(batch: DataFrame, i: int) -> None:
        merge_partitions(batch, table, f"{folder}/stage", keys, parts, ingested=ingested, batch=i)

    q = (records.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(step).start())
    q.awaitTermination()
    return records.sparkSession.read.schema(records.schema).parquet(table)


# ---------------------------------------------------------------- keyed state
def stream_owner_cap(entities: DataFrame, folder: str, limit: int, delay_hours: float = 168.0) -> DataFrame:
    """Admitted entities. A later batch can only use what earlier ones left of the day's limit; see `state.keyed_cap`."""
    return available_now(keyed_cap(entities, limit, delay_hours), folder, mode="update").drop("batch")


def stream_panel_state(readings: DataFrame, cfg: PanelConfig = PanelConfig(), delay_hours: float | None = None) -> DataFrame:
    """Reading count, scheduled count and last reading per entity. Run in update mode."""
    return keyed_panel_state(readings, cfg, cfg.max_track if delay_hours is None else delay_hours)


def stream_decay_label(readings: DataFrame, folder: str, cfg: PanelConfig = PanelConfig(),
                       seq: str | None = None, delay_hours: float | None = None) -> DataFrame:
    """Latest label per entity after all arrived files.

    Equal to `decay_label` over the readings in time and inside the tracking window. `final` is true once the
    newest reading of earlier batches, less the delay, is past the entity's window: nothing can change it
    then. By default a reading may come as late as the window is long.
    """
    labels = keyed_labels(readings, cfg, seq, cfg.max_track if delay_hours is None else delay_hours)
    return latest(available_now(labels, folder, mode="update"), ["entity"])


def stream_sessions(readings: DataFrame, folder: str, gap_hours: float = 3.0, delay_hours: float = 48.0) -> DataFrame:
    """(source, start, last, minutes, closed): every stretch of activity, the open tail included.

    Closed sessions are emitted once. Of those still open the newest statement of each source holds.
    """
    out = available_now(keyed_sessions(readings, gap_hours, delay_hours), folder, mode="update")
    newest = out.groupBy("source").agg(F.max("batch").alias("batch"))
    return out.filter("closed").unionByName(out.filter("NOT closed").join(newest, ["source", "batch"], "left_semi").select(out.columns)).drop("batch")


def outages_between(sessions: DataFrame) -> DataFrame:
    """The quiet time between consecutive sessions of a source. The last session has none: it is still open."""
    w = Window.partitionBy("source").orderBy("start")
    d = sessions.withColumn("resumed_at", F.lead("start").over(w)).filter(F.col("resumed_at").isNotNull())
    return d.select("source", F.col("last").alias("last_data_at"), "resumed_at", S.hours_between("last", "resumed_at").alias("hours_quiet"))


def with_lateness(readings: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Mark each reading serves and how late it is. A late reading is never moved to the mark."""
    mark = F.greatest(*[F.when(F.col("age_hours") >= m - cfg.tolerance, F.lit(float(m))) for m in cfg.schedule])
    return readings.withColumn("mark", mark).withColumns({
        "lateness": F.col("age_hours") - F.col("mark"),
        "late": F.col("age_hours") - F.col("mark") > cfg.tolerance})


def split_late(batch: DataFrame, newest_before, delay_hours: float, ts: str = "reading_ts") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that lie the delay or more behind what was already seen: the watermark's rule."""
    limit = F.unix_millis(F.lit(newest_before).cast("timestamp")) * 1000 - F.lit(int(delay_hours * 3600) * 1_000_000)
    behind = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) <= limit, F.lit(False))
    return batch.filter(~behind), batch.filter(behind)


def stream_split_late(readings: DataFrame, folder: str, delay_hours: float = 48.0, ts: str = "reading_ts") -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): two tables that together hold every row once.

    Both are written by one batch step, each to its own `batch=<id>` folder, with the newest time seen
    so far as a one-row table beside them. A step reads only the row that the step before it left; so a
    repeated batch splits the same way and overwrites what it wrote.
    """
    spark = readings.sparkSession
    path = lambda kind, i: f"{folder}/{kind}/batch={i}"

    def step(batch: DataFrame, i: int) -> None:
        before = spark.read.parquet(path("newest", i - 1)).first()[0] if i else None
        seen = Observation()
        ok, _ = split_late(batch.observe(seen, F.max(F.col(ts).cast("timestamp")).alias("t")), before, delay_hours, ts)
        ok.write.mode("overwrite").parquet(path("in_time", i))
        split_late(batch, before, delay_hours, ts)[1].write.mode("overwrite").parquet(path("late", i))
        newest = max((t for t in (before, seen.get["t"]) if t is not None), default=None)
        spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(path("newest", i))

    q = (readings.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start())
    q.awaitTermination()
    return tuple(spark.read.option("basePath", f"{folder}/{k}").parquet(f"{folder}/{k}/batch=*").drop("batch") for k in ("in_time", "late"))


# ---------------------------------------------------------------- windows
def volume_per(readings: DataFrame, width: str = "1 day", ts: str = "reading_ts", delay: str = "2 days") -> DataFrame:
    """Tumbling volume."""
    return (readings.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("readings"), F.approx_count_distinct("entity").alias("entities"))
            .select(F.col("w.start").alias("start"), "readings", "entities"))


def trailing_coverage(readings: DataFrame, cfg: PanelConfig = PanelConfig(), width: str = "12 hours",
                      slide: str = "1 hour", ts: str = "reading_ts", delay: str = "2 days") -> DataFrame:
    """Sliding share of readings taken on time, over a trailing horizon."""
    d = with_lateness(readings, cfg).withWatermark(ts, delay)
    return (d.groupBy(F.window(ts, width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("readings"),
                 F.avg(F.when(F.col("mark").isNotNull() & ~F.col("late"), 1.0).otherwise(0.0)).alias("on_time"))
            .select(F.col("w.start").alias("start"), "readings", "on_time"))


def enrich(stream: DataFrame, frame: DataFrame, key: str = "owner") -> DataFrame:
    """Stream-static left join with the sampling frame."""
    return stream.join(frame, key, "left")


def heartbeat(readings: DataFrame, folder: str, now_fn: Callable[[], str], max_silent: float = 3.0, ts: str = "reading_ts") -> DataFrame:
    """Newest reading per source and whether collection looks stopped.

    The newest reading is kept by the stream's own state, so a late row never
    moves it back, and every batch judges all sources seen so far, silent ones included.
    """
    def step(batch: DataFrame, i: int) -> DataFrame:
        age = S.hours_between("last_data_at", F.lit(now_fn()).cast("timestamp"))
        return batch.withColumn("hours_silent", age).withColumn("stopped", age > max_silent)

    seen = readings.groupBy("source").agg(F.max(ts).alias("last_data_at"))
    return latest(available_now(seen, folder, mode="complete", each=step), ["source"])


# ---------------------------------------------------------------- breaker
def breaker(attempts: DataFrame, folder: str, trip_at: int = 3) -> DataFrame:
    """State of every source's breaker after all arrived attempts; see `state.keyed_breaker`."""
    return latest(available_now(keyed_breaker(attempts, trip_at), folder, mode="update"), ["source"])

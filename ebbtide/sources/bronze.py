"""The landing zone: append-only JSON lines under platform=<p>/dt=<d>/."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMPS = "_cycle_id string, _ingested_at string, _platform string"

# Identifiers are read as text, whatever JSON type they arrive in.
POSTS_SCHEMA = (
    "post_id string, creator_id string, creator_title string, creator_handle string, "
    "queried_handle string, owned_by_queried_account boolean, published_at string, "
    "discovered_at string, title string, description_len int, caption_len int, tag_count int, "
    "hashtag_count int, mention_count int, coauthor_count int, category_id string, "
    "duration_iso string, media_type string, stratum_tier string, stratum_category string, "
    "views bigint, likes bigint, comments bigint, follower_count bigint, counts_hidden boolean, "
    "comments_disabled boolean, is_video boolean, is_pinned boolean, raw string, " + STAMPS)
READINGS_SCHEMA = (
    "post_id string, creator_id string, snapshot_ts string, published_at string, "
    "age_hours double, views bigint, likes bigint, comments bigint, at_discovery boolean, "
    "media_type string, " + STAMPS)
SCHEMAS = {"posts": POSTS_SCHEMA, "snapshots": READINGS_SCHEMA}

# Natural keys per kind. Kinds without one are only ever appended.
NATURAL_KEYS = {"posts": ("post_id",), "snapshots": ("post_id", "snapshot_ts")}


def _status(spark: SparkSession, path: str):
    """The file system's entry for a path, or None; works for any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def is_file(spark: SparkSession, path: str) -> bool:
    found = _status(spark, path)
    return found is not None and found.isFile()


def kind_files(spark: SparkSession, root: str, kind: str) -> tuple[str, str | None]:
    """(folder, file pattern) of one kind: `<root>/<kind>` as `write_bronze` lays it out, else files named `<kind>-…` under root."""
    own = f"{root.rstrip('/')}/{kind}"
    return (own, None) if _status(spark, own) is not None else (root, f"{kind}-*.json*")


def read_bronze(spark: SparkSession, root: str, kind: str, platform: str | None = None,
                schema: str | None = None) -> DataFrame:
    """All records of one kind. `platform` prunes partitions; `_file` orders replays."""
    folder, pattern = kind_files(spark, root, kind)
    r = spark.read.schema(schema or SCHEMAS[kind]).option("basePath", folder)
    r = r.option("pathGlobFilter", pattern) if pattern else r
    df = r.json(folder).withColumn("_file", F.col("_metadata.file_path"))
    return df if platform is None else df.filter(F.col("platform") == platform)


def cycle_id(now) -> "F.Column":
    """The UTC hour a collection run belongs to."""
    return F.date_format(now, "yyyy-MM-dd'T'HH")


def stamp(df: DataFrame, now, platform: str) -> DataFrame:
    """Add cycle, ingestion and platform stamps where a record lacks them."""
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    values = {"_cycle_id": cycle_id(now),
              "_ingested_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX"),
              "_platform": F.lit(platform)}
    return df.withColumns({n: F.coalesce(F.col(n), v) if n in df.columns else v
                           for n, v in values.items()})


def dedupe_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last write wins per key. Spark keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_bronze(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] | None,
                 ingested: str = "_ingested_at") -> DataFrame:
    """Idempotent merge: the fresher record wins, no record is lost, replays add nothing.

    At equal ingestion stamps the incoming record wins. Without natural keys the
    incoming rows are appended. Rows with a null key are all kept.
    """
    both = (existing.withColumn("_arrival", F.lit(0))
            .unionByName(incoming.withColumn("_arrival", F.lit(1)), allowMissingColumns=True))
    if not keys:
        return both.drop("_arrival")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    kept = dedupe_last(both.filter(whole), list(keys),
                       [F.col(ingested).desc_nulls_last(), F.desc("_arrival"),
                        F.xxhash64(*[c for c in existing.columns if c not in keys])])
    return kept.unionByName(both.filter(~whole)).drop("_arrival")


MAX_LISTED = 1000       # partitions named one by one in a filter; beyond that a join finds them


def _path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _mark(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _publish(spark: SparkSession, stage: str, target: str, schema, fmt: str, parts: tuple[str, ...]) -> None:
    """Replace the partitions of `target` that the stage holds. Doing it again changes nothing."""
    (spark.read.schema(schema).format(fmt).load(f"{stage}/rows").write.format(fmt)
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).save(target))


def _done(spark: SparkSession, staging: str, batch: int) -> None:
    """Note that the target holds this batch; earlier notes go."""
    _mark(spark, f"{staging}/done-{batch}")
    for name in _names(spark, staging):
        if name.startswith("done-") and int(name[5:]) < batch:
            remove(spark, f"{staging}/{name}")


def recover(spark: SparkSession, target: str, staging: str, schema, parts: tuple[str, ...], fmt: str = "parquet") -> None:
    """Finish or discard what an interrupted merge left behind.

    A stage with its READY mark is whole, but may have reached the target in part: it is published again.
    One without the mark never touched the target.
    """
    for name in _names(spark, staging):
        if name.startswith("stage-"):
            stage = f"{staging}/{name}"
            if "READY" in _names(spark, stage):
                _publish(spark, stage, target, schema, fmt, parts)
                if name[6:].isdigit():
                    _done(spark, staging, int(name[6:]))
            remove(spark, stage)


def _touched(target: DataFrame, df: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Rows of `target` in the partitions that `df` has rows for; the others are not read."""
    listed = df.select(*parts).distinct().limit(MAX_LISTED + 1).collect()
    if len(listed) > MAX_LISTED:
        named = df.select(*[F.col(c).alias(f"_t_{c}") for c in parts]).distinct()
        return target.join(named, [target[c].eqNullSafe(named[f"_t_{c}"]) for c in parts], "left_semi")
    here = F.lit(False)
    for row in listed:
        same = F.lit(True)
        for c in parts:
            same = same & F.col(c).eqNullSafe(F.lit(row[c]).cast(df.schema[c].dataType))
        here = here | same
    return target.filter(here)


def merge_partitions(df: DataFrame, target: str, staging: str, keys: tuple[str, ...] | None,
                     parts: tuple[str, ...], fmt: str = "parquet", ingested: str = "_ingested_at", batch: int | None = None) -> None:
    """Merge records into the partitions of `target` they touch; the others stay as they are.

    Spark cannot overwrite files it is reading, so the merged partitions are first written to a stage in
    `staging` (the shared folder, one per target and writer) and replace their originals from there. The
    stage is marked when it is whole and removed when the target has it; the next merge finishes or
    discards what a lost driver left. With `batch`, a rising number, a batch that is in the target already is
    skipped, so that even kinds without keys can be repeated; without it, repeating a keyed merge changes nothing.
    """
    spark = df.sparkSession
    recover(spark, target, staging, df.schema, parts, fmt)
    if batch is not None and any(n.startswith("done-") and int(n[5:]) >= batch for n in _names(spark, staging)):
        return
    if _status(spark, target) is None:
        existing = df.limit(0)
    else:
        existing = _touched(spark.read.schema(df.schema).format(fmt).load(target), df, parts).select(df.columns)
    merged = merge_bronze(existing, df, None if keys is None else tuple(dict.fromkeys((*parts, *keys))), ingested)
    stage = f"{staging}/stage-{uuid.uuid4().hex + 'x' if batch is None else batch}"
    merged.write.mode("overwrite").format(fmt).save(f"{stage}/rows")
    _mark(spark, f"{stage}/READY")
    _publish(spark, stage, target, df.schema, fmt, parts)
    if batch is not None:
        _done(spark, staging, batch)
    remove(spark, stage)


def write_bronze(df: DataFrame, root: str, kind: str, staging: str, batch: int | None = None) -> None:
    """Merge records of one kind into platform=<p>/dt=<d> as JSON lines."""
    merge_partitions(df, f"{root}/{kind}", f"{staging}/{kind}", NATURAL_KEYS.get(kind), ("platform", "dt"), "json", batch=batch)

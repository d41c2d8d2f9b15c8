"""Panels derived from the star-schema tables, in the readings contract.

Each view is built by Spark from the given parquet tables and grows with them.
Running totals are whole numbers, so they do not depend on how a long entity is
cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.operators.skew import running, split_hot

# The event tables span weeks, so the schedule runs on a clock four times slower.
PANEL = PanelConfig().scaled(4)
NOW = "2024-02-01 00:00:00"
COHORTS = (("A", "2024-01-15 00:00:00"), ("B", "2024-01-22 00:00:00"), ("C", "2024-01-29 00:00:00"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _totals(df: DataFrame, sums: dict[str, F.Column], max_rows: int | None = None) -> DataFrame:
    """Running totals per entity in the order (reading_ts, seq)."""
    d = df.withColumn("_at", F.unix_micros("reading_ts"))
    g = split_hot(d, ["entity"], "_at", max_rows)
    g = running(g, ["_at", "seq"], {n: ("sum", c) for n, c in sums.items()})
    return g.result().drop("_at")


def event_panel(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> DataFrame:
    """Entity = user and event type; value = running amount, dipping on every 17th event."""
    e = table(spark, sf_dir, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("entity"),
        F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("reading_ts"),
        F.timestamp_add("HOUR", (F.col("user_id") % 24).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"))
    d = _totals(e, {"cents": F.col("c")}, max_rows).filter(F.col("reading_ts") >= F.col("published_at"))
    dip = F.when(F.col("seq") % 17 == 0, F.lit(0.9)).otherwise(F.lit(1.0))
    return d.select("entity", "owner", "seq", "reading_ts", "published_at",
                    S.hours_between("published_at", "reading_ts").alias("age_hours"),
                    (F.col("cents") / F.lit(100.0) * dip).alias("value"))


def part_panel(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> DataFrame:
    """Entity = part; readings at ship dates, so equal ages occur; value = running quantity."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("entity"), (F.col("l_partkey") % 25).cast("string").alias("owner"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("reading_ts"), F.col("l_orderkey").alias("k"),
        F.col("l_quantity").cast("bigint").alias("c"))
    d = _totals(li, {"total": F.col("c")}, max_rows)
    start = F.lit("1992-01-01").cast("timestamp")
    dip = F.when(F.col("k") % 17 == 0, F.lit(0.9)).otherwise(F.lit(1.0))
    return d.select("entity", "owner", "seq", "reading_ts", start.alias("published_at"),
                    S.hours_between(start, "reading_ts").alias("age_hours"),
                    (F.col("total").cast("double") * dip).alias("value"))


def weekly_panel(spark: SparkSession, sf_dir: str, cfg: PanelConfig = PANEL,
                 max_rows: int | None = None) -> DataFrame:
    """Entity = user and week, with three counters; the source decides which one is the value."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    week = F.date_trunc("WEEK", ts)
    e = e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format(week, "yyyyMMdd")).alias("entity"),
        F.col("user_id").cast("string").alias("owner"),
        F.when(F.col("user_id") % 3 == 0, "photo").otherwise("video").alias("source"),
        F.col("event_id").alias("seq"), ts.alias("reading_ts"),
        F.timestamp_add("HOUR", (F.col("user_id") % 24).cast("int"), week).alias("published_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"), "event_type")
    d = _totals(e, {"cents": F.col("c"), "clicks": (F.col("event_type") == "click").cast("bigint"),
                    "buys": (F.col("event_type") == "purchase").cast("bigint")}, max_rows)
    d = d.filter(F.col("reading_ts") >= F.col("published_at"))
    dip = F.when(F.col("seq") % 17 == 0, F.floor(F.col("cents") / 10)).otherwise(F.lit(0))
    d = d.select("entity", "owner", "source", "seq", "reading_ts", "published_at",
                 S.hours_between("published_at", "reading_ts").alias("age_hours"),
                 (F.col("cents") - dip).alias("views"),
                 F.when(F.col("seq") % 29 != 0, F.col("clicks")).alias("likes"), F.col("buys").alias("comments"))
    return d.withColumns({"primary_metric": S.primary_metric("source", cfg.primary_metric),
                          "value": S.primary_value("source", cfg.primary_metric).cast("double")})


def weekly_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity dimension of `weekly_panel`, with owner attributes from `customer`."""
    e = table(spark, sf_dir, "events").select(
        "user_id", F.date_trunc("WEEK", F.col("ts").cast("timestamp")).alias("week")).distinct()
    c = table(spark, sf_dir, "customer")
    size = F.round(F.col("c_acctbal") * 100).cast("bigint")
    d = e.join(c, e["user_id"] == c["c_custkey"], "left")
    d = d.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("week", "yyyyMMdd")).alias("entity"),
        F.col("user_id").cast("string").alias("owner"),
        F.when(F.col("user_id") % 3 == 0, "photo").otherwise("video").alias("source"),
        F.timestamp_add("HOUR", (F.col("user_id") % 24).cast("int"), F.col("week")).alias("published_at"),
        F.when(size > 0, size).alias("follower_count"),
        F.col("c_mktsegment").alias("stratum_category"),
        F.nullif((F.col("user_id") % 7 * 100).cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.length("c_name").alias("title_len"), F.col("c_nationkey").alias("tag_count"),
        (F.col("user_id") % 41 == 0).alias("counts_hidden"))
    return d.withColumn("stratum_tier", S.tier_of("follower_count"))


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as published entities of few owners, so that owner-days fill up."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("entity"), (F.col("o_custkey") % 7).cast("string").alias("owner"),
        F.when(F.col("o_orderkey") % 4 == 0, "photo").otherwise("video").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"))

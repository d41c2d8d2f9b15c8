"""Building and checking the sampling frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S
from ebbtide.operators.skew import running, split_hot
from ebbtide.sources.bronze import dedupe_last

# The frame's quality limits.
MIN_TIER, MIN_FRAME = 10, 60
GRID_SIZE = 12
MIN_USEFUL_READINGS = 5
OPTIMISM = 0.5               # measured: predictions ran twice too high


def even_spread(pool: DataFrame, group: str, order: list[str], k: int, max_rows: int | None = None) -> DataFrame:
    """Up to `k` evenly spaced rows per group of the ordered pool: positions int(i*n/k)."""
    key = order[0]
    g = split_hot(pool.withColumn("_o", F.col(key).cast("double")), [group], "_o", max_rows)
    g = running(g, order, {"_r": ("sum", F.lit(1))})
    n = pool.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    d = g.result().drop("_o").join(n, group)
    at = F.col("_r") - 1
    i = F.ceil(at * k / F.col("_n"))
    keep = (F.col("_n") <= k) | ((i < k) & (F.floor(i * F.col("_n") / k) == at))
    return d.filter(keep).drop("_r", "_n")


def first_hits(hits: DataFrame, known: DataFrame) -> DataFrame:
    """One row per newly found owner; the first query that found it names its category.

    `hits`: owner, category, query, query_order. Owners already in the frame are dropped.
    """
    new = hits.join(known.select("owner"), "owner", "left_anti")
    return dedupe_last(new, ["owner"], [F.asc("query_order"), F.asc("query")])


def quality_floor(resolved: DataFrame, floors: dict[str, int], min_items: int = 10) -> DataFrame:
    """Owners of the wanted size classes above their floor and not brand new."""
    floor = S.ladder([(F.col("tier") == t, F.lit(v)) for t, v in floors.items()])
    return resolved.withColumn("tier", S.tier_of("subscriber_count")).filter(
        (F.coalesce("subscriber_count", F.lit(0)) >= floor) & (F.coalesce("video_count", F.lit(0)) >= min_items))


def upload_rates(uploads: DataFrame, since, days: float = 30, cap: int = 200, ts: str = "uploaded_at") -> DataFrame:
    """Uploads and their rate per week, counted in full; `saturated` marks owners with `cap` or more."""
    seen = uploads.filter(F.col(ts) >= F.lit(since).cast("timestamp")).groupBy("owner").agg(
        F.count(F.lit(1)).alias("uploads_seen"))
    return seen.select("owner", "uploads_seen", (F.col("uploads_seen") / (days / 7.0)).alias("uploads_per_week"),
                       (F.col("uploads_seen") >= cap).alias("saturated"))


def build_frame(hits: DataFrame, known: DataFrame, resolved: DataFrame, uploads: DataFrame, since,
                floors: dict[str, int], per_tier: int = 15, min_per_week: float = 1.0,
                days: float = 30, cap: int = 200) -> DataFrame:
    """From search hits to a frame that spans each size class.

    Candidates are spread over the class before the rate check (three times the
    target), saturated and slow owners are dropped, and the rest is spread again.
    """
    found = first_hits(hits, known).join(resolved, "owner")
    wide = even_spread(quality_floor(found, floors), "tier", ["subscriber_count", "owner"], 3 * per_tier)
    rated = wide.join(upload_rates(uploads, since, days, cap), "owner")
    pool = rated.filter(~F.col("saturated") & (F.col("uploads_per_week") >= min_per_week))
    return even_spread(pool, "tier", ["subscriber_count", "owner"], per_tier)


def frame_health(frame: DataFrame) -> DataFrame:
    """Owners per size class with the warnings, and how many classes changed when measured."""
    total = frame.agg(F.count(F.lit(1)).alias("frame_total"))
    d = frame.withColumn("tier", S.tier_of("subscriber_count")).groupBy("tier").agg(
        F.count(F.lit(1)).alias("owners"), F.count_distinct("category").alias("categories"),
        F.count_if(F.col("tier_declared").isNotNull() & (F.col("tier_declared") != F.col("tier"))).alias("reclassified"))
    return d.crossJoin(F.broadcast(total)).withColumns({                     # one row
        "tier_too_small": F.col("tier").isin("micro", "mid", "large") & (F.col("owners") < MIN_TIER),
        "frame_too_small": F.col("frame_total") < MIN_FRAME})


def screen_accounts(items: DataFrame, interval_h: float, duration_h: float, grid: int = GRID_SIZE,
                    optimism: float = OPTIMISM) -> DataFrame:
    """Posting rate per account and what it implies for tracking it.

    Pinned items stay at the top of a grid for ever and say nothing about the
    rate, so they are left out: n items span n - 1 intervals.
    """
    unpinned = ~F.coalesce("is_pinned", F.lit(False))
    d = items.groupBy("owner").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(~unpinned).alias("pinned"),
        F.count_if(unpinned).alias("unpinned"),
        F.min(F.when(unpinned, F.col("published_at"))).alias("_a"),
        F.max(F.when(unpinned, F.col("published_at"))).alias("_b"),
        F.count_if(F.coalesce("counts_hidden", F.lit(False))).alias("hidden"))
    d = d.withColumn("span_h", S.hours_between("_a", "_b"))
    status = S.ladder([(F.col("items") < 2, F.lit("too few items")),
                       (F.col("unpinned") < 2, F.lit("too few unpinned items")),
                       (F.col("span_h") <= 0, F.lit("bulk upload"))], F.lit("ok"))
    d = d.withColumn("status", status)
    rate = F.when(F.col("status") == "ok", (F.col("unpinned") - 1) / F.nullif("span_h", F.lit(0.0)))
    d = d.withColumn("_rate", rate).withColumns({
        "per_day": F.col("_rate") * 24, "hours_in_grid": grid / F.col("_rate"),
        "expected_new": F.col("_rate") * duration_h,
        "predicted_readings": F.least(grid / F.col("_rate") / interval_h, F.lit(duration_h / interval_h)) * optimism})
    snaps, new = F.round("predicted_readings", 1), F.round("expected_new", 1)
    verdict = S.ladder([(F.col("status") != "ok", F.lit(None).cast("string")),
                        (F.col("hidden") > 0, F.lit("REJECT")), (snaps < MIN_USEFUL_READINGS, F.lit("REJECT")),
                        (new < 3, F.lit("REJECT")), ((snaps >= 10) & (new >= 6), F.lit("STRONG"))], F.lit("OK"))
    return d.select("owner", "status", "items", "pinned", "span_h", "per_day", "hours_in_grid",
                    "expected_new", "predicted_readings", verdict.alias("verdict"))


def best_accounts(screened: DataFrame, k: int) -> DataFrame:
    """The `k` usable accounts with the most predicted readings."""
    return (screened.filter(F.col("verdict").isin("STRONG", "OK"))
            .orderBy(F.desc("predicted_readings"), "owner").limit(k))

"""Bronze to silver: typed, deduplicated, complete."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.sources.bronze import dedupe_last

# A nested item as the video API returns it. Counters arrive as text.
VIDEO_ITEM = ("id string, snippet struct<channelId: string, channelTitle: string, publishedAt: string, "
              "title: string, description: string, tags: array<string>, categoryId: string, "
              "liveBroadcastContent: string>, "
              "statistics struct<viewCount: string, likeCount: string, commentCount: string>, "
              "contentDetails struct<duration: string>")

_COUNT = "struct<count: bigint>"
GRID_NODE = (
    "struct<shortcode: string, taken_at_timestamp: bigint, like_and_view_counts_disabled: boolean, "
    f"edge_liked_by: {_COUNT}, edge_media_preview_like: {_COUNT}, edge_media_to_comment: {_COUNT}, "
    "edge_media_to_caption: struct<edges: array<struct<node: struct<text: string>>>>, "
    "owner: struct<id: string, username: string, full_name: string>, "
    "coauthor_producers: array<struct<id: string>>, is_video: boolean, video_view_count: bigint, "
    "comments_disabled: boolean, pinned_for_users: array<struct<id: string>>>")
GRID_USER = (
    f"id string, username string, edge_followed_by {_COUNT}, "
    f"edge_owner_to_timeline_media struct<edges: array<struct<node: {GRID_NODE}>>>")


def null_safe_counter(value: Column, disabled: Column) -> Column:
    """A counter that was switched off is unknown, never 0."""
    return F.when(~F.coalesce(disabled, F.lit(False)), value)


def flatten_video_payload(df: DataFrame, payload: str = "raw", keep: list[str] = ()) -> DataFrame:
    """Nested video item (JSON text) to a flat row. Absent counters stay null."""
    d = df.withColumn("_i", F.from_json(payload, VIDEO_ITEM))
    count = lambda n: F.col(f"_i.statistics.{n}").try_cast("bigint")
    sn = lambda n: F.col(f"_i.snippet.{n}")
    return d.select(
        *keep, F.col("_i.id").alias("post_id"), sn("channelId").alias("creator_id"),
        sn("channelTitle").alias("creator_title"), sn("publishedAt").alias("published_at"),
        sn("title").alias("title"),
        F.length(F.coalesce(sn("description"), F.lit(""))).alias("description_len"),
        F.when(sn("tags").isNull(), 0).otherwise(F.size(sn("tags"))).alias("tag_count"),
        sn("categoryId").alias("category_id"), F.col("_i.contentDetails.duration").alias("duration_iso"),
        count("viewCount").alias("views"), count("likeCount").alias("likes"),
        count("commentCount").alias("comments"))


def flatten_grid_payload(df: DataFrame, payload: str = "raw", queried: str = "queried_handle") -> DataFrame:
    """Profile grid (JSON text) to one row per item.

    Hidden counts become null, the preview edge stands in for missing likes, the
    item's own account is kept apart from the account queried, and items without
    id or time are dropped. Sort by `published_at` descending for display order.
    """
    d = df.withColumn("_u", F.from_json(payload, GRID_USER))
    d = d.select(queried, F.col("_u.id").alias("_uid"),
                 F.col("_u.edge_followed_by.count").alias("follower_count"),
                 F.explode("_u.edge_owner_to_timeline_media.edges").alias("_e"))
    n = lambda p: F.col(f"_e.node.{p}")
    hidden = F.coalesce(n("like_and_view_counts_disabled"), F.lit(False))
    off = F.coalesce(n("comments_disabled"), F.lit(False))
    caption = F.coalesce(F.get(n("edge_media_to_caption.edges"), F.lit(0))["node"]["text"], F.lit(""))
    mentions = lambda ch: F.length(caption) - F.length(F.replace(caption, F.lit(ch), F.lit("")))
    count = lambda a: F.when(a.isNull(), 0).otherwise(F.size(a))
    video = F.coalesce(n("is_video"), F.lit(False))
    return d.filter((n("shortcode") != "") & (n("taken_at_timestamp") != 0)).select(
        F.concat(F.lit("ig_"), n("shortcode")).alias("post_id"),
        F.coalesce(n("owner.id"), F.col("_uid")).alias("creator_id"),
        F.col(queried).alias("queried_handle"),
        n("owner.username").alias("creator_handle"),
        (n("owner.id").isNull() | n("owner.id").eqNullSafe(F.col("_uid"))).alias("owned_by_queried_account"),
        count(n("coauthor_producers")).alias("coauthor_count"),
        F.timestamp_seconds(n("taken_at_timestamp")).alias("published_at"),
        video.alias("is_video"), F.when(video, "video").otherwise("image").alias("media_type"),
        n("video_view_count").alias("views"),
        null_safe_counter(F.coalesce(n("edge_liked_by.count"), n("edge_media_preview_like.count")),
                          hidden).alias("likes"),
        null_safe_counter(n("edge_media_to_comment.count"), off).alias("comments"),
        hidden.alias("counts_hidden"), off.alias("comments_disabled"),
        F.length(caption).alias("caption_len"), mentions("#").alias("hashtag_count"),
        mentions("@").alias("mention_count"),
        (count(n("pinned_for_users")) > 0).alias("is_pinned"),
        F.col("follower_count"))


def entity_dimension(posts: DataFrame, source: str = "platform") -> DataFrame:
    """The entity table: ids as text, lengths with 0 read as missing, parsed times.

    Records without an id or a publication time are dropped; the latest
    ingestion of an id wins.
    """
    kept = dedupe_last(posts.withColumn("entity", S.canonical_id("post_id")), ["entity"],
                       [F.col("_ingested_at").desc_nulls_last(), F.desc("_file") if "_file" in posts.columns
                        else F.lit(0)])
    handle = F.coalesce(F.nullif("creator_handle", F.lit("")), "creator_title")
    out = kept.select(
        "entity", F.col(source).alias("source"), S.canonical_id("creator_id").alias("owner"),
        handle.alias("owner_handle"),
        F.coalesce(F.nullif("queried_handle", F.lit("")), "creator_handle").alias("queried_handle"),
        "owned_by_queried_account",
        S.parse_utc("published_at").alias("published_at"), S.parse_utc("discovered_at").alias("discovered_at"),
        "stratum_tier", "stratum_category",
        F.coalesce(F.nullif("media_type", F.lit("")), F.lit("video")).alias("media_type"),
        F.nullif(F.length("title"), F.lit(0)).alias("title_len"),
        "description_len", "caption_len", "tag_count", "hashtag_count", "mention_count", "duration_iso",
        S.iso_duration_seconds("duration_iso").alias("duration_sec"), "category_id", "follower_count",
        F.coalesce("counts_hidden", F.lit(False)).alias("counts_hidden"))
    return out.filter(F.col("entity").isNotNull() & F.col("published_at").isNotNull())


def attach_size(entities: DataFrame, frame: DataFrame, source: str | None = None) -> DataFrame:
    """Fill a missing follower count from the sampling frame (`owner`, `subscriber_count`).

    A value already present wins; `source` limits the fill to one source.
    """
    sizes = (frame.filter(F.col("owner").isNotNull()).groupBy("owner")
             .agg(F.max("subscriber_count").alias("_size")))
    here = F.lit(True) if source is None else (F.col("source") == source)
    return (entities.join(sizes, "owner", "left")
            .withColumn("follower_count", F.coalesce("follower_count", F.when(here, F.col("_size"))))
            .select(*entities.columns))


def owner_daily_cap(entities: DataFrame, caps: Mapping[str, int]) -> DataFrame:
    """Flag entities past their source's limit per owner and UTC day; the earliest stay.

    Only the first N of an owner-day travel: the row-number limit is applied
    before the shuffle, so a bulk uploader's day never gathers in one task, and
    the flag comes back by a join on the unique entity id.
    """
    limits = [(F.col("source") == s, F.lit(int(n))) for s, n in caps.items() if n > 0]
    if not limits:
        return entities.withColumn("over_daily_cap", F.lit(False))
    most = max(n for n in caps.values())
    limit = S.ladder(limits)
    w = Window.partitionBy("owner", "_day").orderBy("published_at", "entity")
    first = (entities.select("entity", "owner", "source", "published_at")
             .withColumn("_day", F.to_date("published_at"))
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
             .filter(F.col("_rn") <= limit).select("entity", F.lit(True).alias("_within")))
    return (entities.join(first, "entity", "left")
            .withColumn("over_daily_cap", limit.isNotNull() & F.col("_within").isNull())
            .drop("_within"))


def readings_table(snapshots: DataFrame, cfg: PanelConfig = PanelConfig(), source: str = "platform") -> DataFrame:
    """The readings table: deduplicated by (entity, time), age recomputed, metric resolved."""
    d = snapshots.withColumns({"entity": S.canonical_id("post_id"),
                               "reading_ts": S.parse_utc("snapshot_ts"),
                               "published_at": S.parse_utc("published_at")})
    d = dedupe_last(d, ["entity", "reading_ts"], [F.col("_ingested_at").desc_nulls_last()])
    d = d.select(
        "entity", F.col(source).alias("source"), S.canonical_id("creator_id").alias("owner"),
        "reading_ts", "published_at",
        S.age_hours("reading_ts", "published_at", "age_hours").alias("age_hours"),
        "views", "likes", "comments",
        S.primary_metric(source, cfg.primary_metric).alias("primary_metric"),
        S.primary_value(source, cfg.primary_metric).cast("double").alias("value"),
        F.coalesce("at_discovery", F.lit(False)).alias("at_discovery"))
    return d.filter(F.col("entity").isNotNull() & F.col("reading_ts").isNotNull() & (F.col("age_hours") >= 0))


def orphan_readings(readings: DataFrame, entities: DataFrame) -> DataFrame:
    """Readings of entities that were never admitted."""
    return readings.join(entities.select("entity"), "entity", "left_anti")


def drop_capped(rows: DataFrame, entities: DataFrame) -> DataFrame:
    return rows.join(entities.filter("over_daily_cap").select("entity"), "entity", "left_anti")


def exclude_hidden(entities: DataFrame) -> DataFrame:
    """Hidden counters read as 0, which would look like instant death."""
    return entities.filter(~F.coalesce("counts_hidden", F.lit(False)))


def build_summary(entities: DataFrame, readings: DataFrame) -> DataFrame:
    """One row of build counts. The readings are aggregated per entity once."""
    per = readings.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    known = entities.select("entity", F.lit(True).alias("_known"))
    r = (per.join(known, "entity", "left")
         .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
              F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_readings"),
              F.count_if(F.col("n") >= 3).alias("entities_with_3plus")))
    e = entities.agg(F.count(F.lit(1)).alias("entities"),
                     F.count_if("over_daily_cap").alias("over_cap"),
                     F.count_if(~F.col("over_daily_cap")).alias("analysable"))
    return e.crossJoin(r)                                   # one row by one row


def readings_by_source(readings: DataFrame) -> DataFrame:
    return readings.groupBy("source").agg(F.count(F.lit(1)).alias("readings"))

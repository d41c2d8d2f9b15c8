"""Landing, merging, typing: bronze to silver."""

import uuid

from pyspark.sql import functions as F

from checks.registry import query, r
from checks.views_sql import WEEKLY_ENTITIES, WEEKLY_PANEL, hours
from ebbtide.functions import scalars as S
from ebbtide.operators import silver
from ebbtide.plans.views import PANEL, table, weekly_entities, weekly_panel
from ebbtide.session import checkpoint_dir
from ebbtide.sources import bronze, tables


def records(spark, sf):
    """Two overlapping deliveries of the orders as ingested records."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("post_id"), F.col("o_orderstatus").alias("status"),
        "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("_ingested_at"), "o_orderkey")
    first = o.filter(F.col("o_orderkey") % 3 != 0)
    second = o.filter(F.col("o_orderkey") % 2 == 0).withColumns({
        "status": F.lit("late"), "_ingested_at": F.when(F.col("o_orderkey") % 5 == 0, F.lit("1900-01-01T00:00:00"))
        .otherwise(F.col("_ingested_at"))})
    return first, second


@query("merge_bronze", """SELECT CAST(o_orderkey AS VARCHAR) AS post_id,
  CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) THEN 'late' ELSE o_orderstatus END AS status,
  round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def merge_bronze(spark, sf):
    a, b = records(spark, sf)
    once = bronze.merge_bronze(a, b, ("post_id",))
    again = bronze.merge_bronze(once, b, ("post_id",))              # a replay adds nothing
    return again.select("post_id", "status", "o_totalprice")


@query("dedupe_last", """SELECT l_partkey, l_suppkey, arg_max(l_orderkey * 100 + l_linenumber, l_orderkey * 100 + l_linenumber) AS seq,
  round(arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber), 6) AS l_extendedprice FROM lineitem GROUP BY ALL""")
def dedupe_last(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return bronze.dedupe_last(li, ["l_partkey", "l_suppkey"], [F.desc("seq")]).select(
        "l_partkey", "l_suppkey", "seq", "l_extendedprice")


@query("stamp", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'known' ELSE strftime(o_orderdate, '%Y-%m-%dT%H') END AS _cycle_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'photo' ELSE 'video' END AS _platform FROM orders""")
def stamp(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"),
        F.when(F.col("o_orderkey") % 2 == 0, "known").alias("_cycle_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "photo").alias("_platform"))
    return bronze.stamp(o, F.col("at"), "video").select("o_orderkey", "_cycle_id", "_platform")


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("bronze_roundtrip", f"""WITH {WEEKLY_PANEL} SELECT source AS platform, entity AS post_id, count(*) AS readings,
  CAST(sum(views) AS BIGINT) AS views, count(likes) AS with_likes FROM p WHERE source = 'video' GROUP BY ALL""")
def bronze_roundtrip(spark, sf):
    """Readings written as partitioned JSON lines, twice, then read back for one source."""
    p = weekly_panel(spark, sf).select(
        F.col("entity").alias("post_id"), F.col("owner").alias("creator_id"),
        F.date_format("reading_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("snapshot_ts"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"), "views", "likes", "comments",
        F.col("source").alias("platform"), F.to_date("reading_ts").alias("dt"),
        F.lit("2024-02-01T00:00:00Z").alias("_ingested_at"))
    root, stage = fresh_folder(spark, "bronze"), fresh_folder(spark, "stage")
    bronze.write_bronze(p, root, "snapshots", stage)
    bronze.write_bronze(p.filter(F.dayofmonth("dt") <= 10), root, "snapshots", stage)    # replay of some days
    return bronze.read_bronze(spark, root, "snapshots", "video").groupBy("platform", "post_id").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("views").alias("views"), F.count("likes").alias("with_likes"))


@query("silver_roundtrip", f"""WITH {WEEKLY_ENTITIES} SELECT stratum_tier, count(*) AS entities, CAST(sum(title_len) AS BIGINT) AS title_len
  FROM en GROUP BY stratum_tier""")
def silver_roundtrip(spark, sf):
    path = fresh_folder(spark, "silver")
    tables.write_silver(weekly_entities(spark, sf), path)
    return tables.read_silver(spark, path).groupBy("stratum_tier").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("title_len").alias("title_len"))


def snapshots(spark, sf):
    """Raw readings as collected: text times, every third one twice, some without a publication time."""
    p = weekly_panel(spark, sf).select(
        F.concat("entity", F.lit(".0")).alias("post_id"), F.col("owner").alias("creator_id"),
        F.date_format("reading_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("snapshot_ts"),
        F.when(F.col("seq") % 11 != 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
        (F.col("age_hours") + 1).alias("age_hours"), "views", "likes", "comments",
        F.lit(False).alias("at_discovery"), F.col("source").alias("platform"), "seq",
        F.lit("2024-02-01T00:00:00Z").alias("_ingested_at"))
    stale = p.filter(F.col("seq") % 3 == 0).withColumns(
        {"views": F.lit(-1).cast("bigint"), "_ingested_at": F.lit("2024-01-31T00:00:00Z")})
    return p.unionByName(stale)


@query("readings_table", f"""WITH {WEEKLY_PANEL} SELECT entity || '.0' AS entity, source, owner, primary_metric, {r('~value')},
  strftime(reading_ts, '%Y-%m-%d %H:%M:%S') AS reading_ts, round(CASE WHEN seq % 11 <> 0 THEN age_hours ELSE age_hours + 1 END, 6) AS age_hours,
  views, likes, comments FROM p""")
def readings_table(spark, sf):
    return silver.readings_table(snapshots(spark, sf), PANEL).select(
        "entity", "source", "owner", "primary_metric", "value", "reading_ts", "age_hours", "views", "likes", "comments")


def posts(spark, sf):
    """Raw posts: numeric-looking ids, ISO durations, blanks, a second sighting of some."""
    e = weekly_entities(spark, sf)
    d = e.select(
        F.concat(F.col("owner"), F.date_format("published_at", "MMdd"), F.lit(".0")).alias("post_id"),
        F.concat(F.col("owner"), F.lit(".0")).alias("creator_id"),
        F.when(F.col("title_len") % 2 == 0, "").otherwise(F.concat(F.lit("h"), "owner")).alias("creator_handle"),
        F.concat(F.lit("t"), "owner").alias("creator_title"), F.lit(None).cast("string").alias("queried_handle"),
        F.lit(None).cast("boolean").alias("owned_by_queried_account"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.lit("not a time").alias("discovered_at"), "stratum_tier", "stratum_category",
        F.when(F.col("source") == "photo", "image").alias("media_type"),
        F.when(F.col("tag_count") % 5 == 0, "").otherwise(F.col("stratum_category")).alias("title"),
        "title_len", F.lit(1).alias("description_len"), F.lit(None).cast("int").alias("caption_len"), "tag_count",
        F.lit(0).alias("hashtag_count"), F.lit(0).alias("mention_count"),
        F.concat(F.lit("PT"), F.coalesce(F.col("duration_sec"), F.lit(0)).cast("int"), F.lit("S")).alias("duration_iso"),
        F.lit("22").alias("category_id"), "follower_count",
        F.when(F.col("counts_hidden"), F.lit(True)).alias("counts_hidden"), F.col("source").alias("platform"),
        F.lit("2024-02-01").alias("_ingested_at"))
    return d.unionByName(d.filter(F.col("tag_count") % 2 == 0).withColumns(
        {"stratum_tier": F.lit("stale"), "_ingested_at": F.lit("2024-01-01")}))


@query("entity_dimension", f"""WITH {WEEKLY_ENTITIES} SELECT owner || strftime(published_at, '%m%d') AS entity, source, owner,
  CASE WHEN title_len % 2 = 0 THEN 't' || owner ELSE 'h' || owner END AS owner_handle, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  stratum_tier, stratum_category, CASE WHEN source = 'photo' THEN 'image' ELSE 'video' END AS media_type,
  CASE WHEN tag_count % 5 <> 0 THEN length(stratum_category) END AS title_len, round(duration_sec, 6) AS duration_sec,
  CAST(follower_count AS BIGINT) AS follower_count, counts_hidden FROM en""")
def entity_dimension(spark, sf):
    return silver.entity_dimension(posts(spark, sf)).select(
        "entity", "source", "owner", "owner_handle", "published_at", "stratum_tier", "stratum_category", "media_type",
        "title_len", "duration_sec", "follower_count", "counts_hidden")


@query("attach_size", f"""WITH {WEEKLY_ENTITIES} SELECT entity, CAST(coalesce(CASE WHEN tag_count % 2 = 0 THEN follower_count END,
  CASE WHEN source = 'video' THEN c_custkey * 10 END) AS BIGINT) AS follower_count FROM en LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = owner""")
def attach_size(spark, sf):
    e = weekly_entities(spark, sf).withColumn("follower_count", F.when(F.col("tag_count") % 2 == 0, F.col("follower_count")))
    frame = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("owner"),
                                                (F.col("c_custkey") * 10).alias("subscriber_count"))
    return silver.attach_size(e, frame, "video").select("entity", "follower_count")


@query("orphan_readings", f"""WITH {WEEKLY_PANEL} SELECT entity, count(*) AS n FROM p WHERE owner NOT IN
  (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12) GROUP BY entity""")
def orphan_readings(spark, sf):
    e = weekly_entities(spark, sf).filter(F.col("tag_count") < 12)
    return silver.orphan_readings(weekly_panel(spark, sf), e).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("exclude_hidden", f"WITH {WEEKLY_ENTITIES} SELECT entity FROM en WHERE NOT counts_hidden")
def exclude_hidden(spark, sf):
    return silver.exclude_hidden(weekly_entities(spark, sf)).select("entity")


@query("build_summary", f"""WITH {WEEKLY_PANEL}, {WEEKLY_ENTITIES}, e AS (SELECT *, row_number() OVER (PARTITION BY owner, CAST(published_at AS DATE)
    ORDER BY published_at, entity) > 5 AND source = 'video' AS over FROM en WHERE tag_count < 12),
  c AS (SELECT entity, count(*) AS n FROM p GROUP BY entity)
  SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM e WHERE over) AS over_cap, (SELECT count(*) FROM e WHERE NOT over) AS analysable,
  CAST(sum(n) AS BIGINT) AS readings, CAST(coalesce(sum(n) FILTER (entity NOT IN (SELECT entity FROM e)), 0) AS BIGINT) AS orphan_readings,
  count(*) FILTER (n >= 3) AS entities_with_3plus FROM c""")
def build_summary(spark, sf):
    e = silver.owner_daily_cap(weekly_entities(spark, sf).filter(F.col("tag_count") < 12), PANEL.daily_cap)
    return silver.build_summary(e, weekly_panel(spark, sf))


@query("readings_by_source", f"WITH {WEEKLY_PANEL} SELECT source, count(*) AS readings FROM p GROUP BY source")
def readings_by_source(spark, sf):
    return silver.readings_by_source(weekly_panel(spark, sf))


@query("flatten_video_payload", """SELECT 'v' || doc_id AS post_id, source AS creator_id, length(text) AS description_len,
  CAST(doc_id % 4 AS BIGINT) AS tag_count, 'PT' || (doc_id % 90) || 'M' AS duration_iso, n_chars AS views,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS likes, CAST(NULL AS BIGINT) AS comments, text AS title FROM documents""")
def flatten_video_payload(spark, sf):
    """Whole documents packed into nested items as the video API sends them, then flattened."""
    n = F.col("n_chars").cast("string")
    item = F.struct(
        F.concat(F.lit("v"), "doc_id").alias("id"),
        F.struct(F.col("source").alias("channelId"), F.col("text").alias("description"), F.col("text").alias("title"),
                 F.when(F.col("doc_id") % 4 > 0, F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int")),
                                                             lambda i: i.cast("string"))).alias("tags")).alias("snippet"),
        F.struct(n.alias("viewCount"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("likeCount"),
                 F.lit("not a number").alias("commentCount")).alias("statistics"),
        F.struct(F.concat(F.lit("PT"), F.col("doc_id") % 90, F.lit("M")).alias("duration")).alias("contentDetails"))
    d = table(spark, sf, "documents").select(F.to_json(item).alias("raw"))
    return silver.flatten_video_payload(d).select("post_id", "creator_id", "description_len", "tag_count", "duration_iso",
                                                  "views", "likes", "comments", "title")


@query("flatten_grid_payload", """WITH n AS (SELECT *, text || ' #' || role || ' @x' AS caption FROM conversations)
  SELECT 'ig_' || conv_id || 'x' || turn AS post_id, CASE WHEN turn % 3 = 0 THEN 'u' || conv_id ELSE 'o' || turn END AS creator_id,
  turn % 3 = 0 AS owned_by_queried_account, strftime(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS published_at,
  CASE WHEN turn % 2 = 1 THEN length(text) END AS views, CASE WHEN turn % 4 <> 0 THEN conv_id END AS likes,
  CASE WHEN turn % 5 <> 0 THEN turn END AS comments, length(caption) AS caption_len,
  length(caption) - length(replace(caption, '#', '')) AS hashtag_count, length(caption) - length(replace(caption, '@', '')) AS mention_count,
  turn % 4 = 0 AS counts_hidden, turn = 0 AS is_pinned, CASE WHEN turn % 2 = 1 THEN 'video' ELSE 'image' END AS media_type FROM n""")
def flatten_grid_payload(spark, sf):
    """Whole conversations packed into profile grids, one grid per conversation."""
    c = table(spark, sf, "conversations")
    count = lambda x: F.struct(x.alias("count"))
    node = F.struct(
        F.concat(F.col("conv_id"), F.lit("x"), F.col("turn")).alias("shortcode"),
        (F.lit(1704067200) + F.col("turn") * 60).alias("taken_at_timestamp"),
        (F.col("turn") % 4 == 0).alias("like_and_view_counts_disabled"),
        F.when(F.col("turn") % 2 == 0, count(F.col("conv_id"))).alias("edge_liked_by"),
        count(F.col("conv_id")).alias("edge_media_preview_like"), count(F.col("turn")).alias("edge_media_to_comment"),
        F.struct(F.array(F.struct(F.struct(F.concat("text", F.lit(" #"), "role", F.lit(" @x")).alias("text")).alias("node"))).alias("edges"))
        .alias("edge_media_to_caption"),
        F.when(F.col("turn") % 3 != 0, F.struct(F.concat(F.lit("o"), "turn").alias("id"))).alias("owner"),
        (F.col("turn") % 2 == 1).alias("is_video"), F.when(F.col("turn") % 2 == 1, F.length("text")).alias("video_view_count"),
        (F.col("turn") % 5 == 0).alias("comments_disabled"),
        F.when(F.col("turn") == 0, F.array(F.struct(F.lit("1").alias("id")))).alias("pinned_for_users"))
    # One item per payload keeps a grid's size independent of the conversation's length.
    user = F.struct(F.concat(F.lit("u"), "conv_id").alias("id"), count(F.col("conv_id")).alias("edge_followed_by"),
                    F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("edge_owner_to_timeline_media"))
    d = c.select(F.concat(F.lit("h"), "conv_id").alias("queried_handle"), F.to_json(user).alias("raw"))
    return silver.flatten_grid_payload(d).select(
        "post_id", "creator_id", "owned_by_queried_account", "published_at", "views", "likes", "comments", "caption_len",
        "hashtag_count", "mention_count", "counts_hidden", "is_pinned", "media_type")


@query("null_safe_counter", """SELECT l_returnflag, count(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS known,
  CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS DOUBLE) AS total FROM lineitem GROUP BY 1""")
def null_safe_counter(spark, sf):
    q = silver.null_safe_counter(F.col("l_quantity"), F.col("l_linenumber") % 2 != 0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(q).alias("known"), F.sum(q).alias("total"))


@query("canonical_id", """SELECT CAST(c_custkey AS VARCHAR) AS id, regexp_replace(CAST(c_acctbal AS VARCHAR), '^(-?[0-9]+)\\.0$', '\\1') AS bal FROM customer""")
def canonical_id(spark, sf):
    return table(spark, sf, "customer").select(S.canonical_id(F.col("c_custkey").cast("double").cast("decimal(20,1)")).alias("id"),
                                               S.canonical_id("c_acctbal").alias("bal"))


@query("parse_utc", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN
  strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def parse_utc(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(F.col("o_orderkey") % 3 == 0, "soon").when(F.col("o_orderkey") % 3 == 1, F.concat(text, F.lit("-03:00")))
           .otherwise(F.concat(text, F.lit("Z"))))
    return table(spark, sf, "orders").select("o_orderkey", S.parse_utc(raw).alias("at"))


@query("iso_duration_seconds", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(CAST(l_quantity * 3600 + (l_partkey % 60) * 60 + l_suppkey % 7 AS DOUBLE), 0)
  * CASE WHEN l_linenumber = 1 THEN NULL ELSE 1 END AS seconds FROM lineitem""")
def iso_duration_seconds(spark, sf):
    iso = F.concat(F.when(F.col("l_linenumber") == 1, "P1DT").otherwise("PT"), F.col("l_quantity").cast("int"), F.lit("H"),
                   F.col("l_partkey") % 60, F.lit("M"), F.col("l_suppkey") % 7, F.lit("S"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.iso_duration_seconds(iso).alias("seconds"))


@query("age_hours", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round({hours('o_orderdate', 'l_shipdate')}, 6) AS age
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {hours('o_orderdate', 'l_shipdate')} >= 0""")
def age_hours(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", S.age_hours("l_shipdate", "o_orderdate").alias("age")).filter("age >= 0")


@query("primary_metric", f"WITH {WEEKLY_PANEL} SELECT primary_metric, count(*) AS n, count(value) AS known FROM p GROUP BY 1")
def primary_metric(spark, sf):
    return weekly_panel(spark, sf).groupBy("primary_metric").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))


@query("redact_keys", """SELECT doc_id, md5(replace(text, 'the', 'REDACTED') || '?key=REDACTED&part=1&key=REDACTED') AS digest, length(text) AS n
  FROM documents""")
def redact_keys(spark, sf):
    leaked = F.concat("text", F.lit("?key="), F.md5("text"), F.lit("&part=1&key="), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.md5(S.redact(leaked, ["the"])).alias("digest"), F.length("text").alias("n"))


@query("extract_video_id", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN substr(md5(url), 1, 11) WHEN 1 THEN substr(md5(url), 1, 11)
  WHEN 2 THEN substr(md5(url), 1, 11) END AS id, CASE WHEN page_id % 5 = 0 THEN substr(md5(url), 1, 11) END AS bare FROM pages""")
def extract_video_id(spark, sf):
    key = F.substring(F.md5("url"), 1, 11)
    k = F.col("page_id") % 4
    link = (F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), key, F.lit("&ref=x")))
            .when(k == 1, F.concat(F.lit("youtu.be/"), key, F.lit("?si=1")))
            .when(k == 2, F.concat(F.lit("HTTP://M.YouTube.com/shorts/"), key)).otherwise(F.col("url")))
    bare = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  "), key, F.lit(" "))).otherwise(F.concat("url", key))
    return table(spark, sf, "pages").select("page_id", S.video_id(link).alias("id"), S.video_id(bare).alias("bare"))


@query("strict_json", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio,
  CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS nested FROM lineitem""")
def strict_json(spark, sf):
    bad = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).when(
        F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bad.alias("ratio"),
                                            F.array(F.struct(bad.alias("x"))).alias("deep"))
    return tables.strict_json(d).select("l_orderkey", "l_linenumber", "ratio", F.col("deep")[0]["x"].alias("nested"))


@query("strip_identifiers", """SELECT o_orderkey, false AS leaks, round(o_totalprice, 6) AS price FROM orders""")
def strip_identifiers(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("creator_id"),
        F.struct(F.col("o_orderkey").alias("post_id"), F.array(F.struct(
            F.col("o_custkey").alias("channel_id"), F.col("o_totalprice").alias("price"))).alias("side")).alias("pair"))
    clean = tables.strip_identifiers(o)
    text = F.to_json(F.struct(*clean.columns))
    return clean.select("o_orderkey", text.rlike("creator_id|channel_id|post_id").alias("leaks"),
                        F.col("pair.side")[0]["price"].alias("price"))


@query("cycle_logs", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS runs, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS units,
  count(*) FILTER (o_orderstatus = 'F') AS blocked FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1""")
def cycle_logs(spark, sf):
    """Run logs written as nested JSON and read back; every fiftieth is cut off and skipped."""
    path = fresh_folder(spark, "cycles")
    log = F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH").alias("cycle_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"),
        (F.col("o_orderstatus") == "F").alias("quota_exceeded"),
        F.struct(F.floor("o_totalprice").cast("bigint").alias("units_spent")).alias("quota")))
    cut = F.when(F.col("o_orderkey") % 50 == 0, F.substring(log, 1, 40)).otherwise(log)
    table(spark, sf, "orders").select(cut.alias("value")).write.text(path)
    logs = tables.read_cycle_logs(spark, path, per_line=True)
    return logs.groupBy(F.substring("started_at", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("quota.units_spent").alias("units"), F.count_if("quota_exceeded").alias("blocked"))


@query("read_frame", "SELECT c_mktsegment AS category, count(*) AS owners FROM customer GROUP BY 1")
def read_frame(spark, sf):
    path = fresh_folder(spark, "frame")
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.json(path)
    f = tables.read_frame(spark, path, schema="c_custkey string, c_mktsegment string")
    return f.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count(F.lit(1)).alias("owners"))

"""Shards under a byte limit by extendible hashing.

A row's hash starts with the bits of its shard. The directory comes from a histogram of bytes
per hash prefix, a few cells per shard: a cell's shard is the shortest prefix whose bytes fit.
Only cells still over the limit are read again, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT = 16 << 20
BITS = 60
SPARE_BITS = 4          # histogram cells per shard, as a power of two
MORE_BITS = 14


def row_hash(key, text) -> Column:
    """60 bits of key and text: copies of a row share it, rows that only share a key do not."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(text)).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(h, bits) -> Column:
    """The first `bits` bits; `bits` may differ by row."""
    return F.expr(f"shiftright({h}, cast({BITS} - {bits} AS int))")


def _leaves(hist: DataFrame, start: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, bytes) for cells of `bits` bits: the shortest prefix from `start` bits on that fits
    the limit or holds one hash. Cells that no prefix settles have a null depth."""
    up = hist.select("*", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("d"))
    up = up.withColumn("p", F.expr(f"shiftright(cell, cast({bits} - d AS int))"))
    sums = (up.groupBy("d", "p").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter((F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
            .select("d", "p", F.col("b").alias("leaf_b"), (F.col("lo") == F.col("hi")).alias("one")))
    best = (up.select("cell", "d", "p").join(sums, ["d", "p"])
            .groupBy("cell").agg(F.min(F.struct("d", "leaf_b", "one")).alias("x"))
            .select("cell", F.col("x.d").alias("depth"), F.col("x.leaf_b").alias("leaf_b"), F.col("x.one").alias("one")))
    return hist.select("cell").join(best, "cell", "left")


def shard(docs: DataFrame, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with __depth, __prefix, __page, __bytes (of the row's text) and __shard_bytes.

    A shard is (depth, prefix, page). No shard is over `limit` bytes unless a single row is.
    Copies of one row share all hash bits; if they exceed the limit together they are dealt to
    pages. Null texts weigh 0 bytes, null keys hash like empty ones, equal hashes stay together;
    an empty table gives an empty result.
    """
    df = docs.withColumn("__h", row_hash(key, text)).withColumn("__bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"))
    total = df.agg(F.sum("__bytes")).first()[0] or 0
    bits = min(28, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS)
    start, lookup, deep, levels = 0, None, df, []
    while True:
        cell = _prefix("__h", bits)
        hist = deep.groupBy(cell.alias("cell")).agg(F.sum("__bytes").alias("b"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))
        leaves = _leaves(hist, start, bits, limit).checkpoint()         # a few cells per shard
        new = leaves.select(F.lit(bits).alias("bits"), "cell", "depth", "leaf_b", "one")
        lookup = new if lookup is None else lookup.unionByName(new)
        levels.append(bits)
        open_cells = leaves.filter("depth IS NULL").select("cell")
        if bits >= BITS or open_cells.isEmpty():
            break
        deep = df.withColumn("cell", cell).join(open_cells, "cell", "left_semi").drop("cell")
        start, bits = bits + 1, min(BITS, bits + MORE_BITS)
    out = None
    for b in levels:                                                    # one join unless some cells went deeper
        found = lookup.filter(F.col("bits") == b).select(
            F.col("cell").alias("__cell"), F.col("depth").alias("__d"), F.col("leaf_b").alias("__lb"), F.col("one").alias("__one"))
        if out is None:
            out = df.withColumn("__cell", _prefix("__h", b)).join(found, "__cell").drop("__cell") \
                .withColumnsRenamed({"__d": "__depth", "__lb": "__leaf", "__one": "__single"})
        else:
            out = out.withColumn("__cell", _prefix("__h", b)).join(found, "__cell", "left").drop("__cell")
            out = out.withColumns({"__depth": F.coalesce("__depth", "__d"), "__leaf": F.coalesce("__leaf", "__lb"),
                                   "__single": F.coalesce("__single", "__one")}).drop("__d", "__lb", "__one")
    out = out.withColumn("__prefix", _prefix("__h", "__depth"))
    full = (F.col("__leaf") > limit) & F.col("__single")
    plain = out.filter(~full).withColumn("__page", F.lit(0).cast("bigint")).withColumn("__shard_bytes", F.col("__leaf"))
    return plain.unionByName(_paged(out.filter(full), limit)).drop("__h", "__leaf", "__single")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Copies of one row, dealt to pages of at most `limit` bytes: counted, then written out again page by page."""
    names = rows.columns
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__bytes", F.lit(1)))).cast("bigint")
    # Rows that share a hash but not their other columns continue each other's pages.
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__paged_n")).withColumn("__per", per)
    before = W.partitionBy("__h").orderBy(F.hash(*names), "__paged_n").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("__from", F.coalesce(F.sum("__paged_n").over(before), F.lit(0)))
    first, last = F.expr("__from div __per"), F.expr("(__from + __paged_n - 1) div __per")
    pages = counted.withColumn("__page", F.explode(F.sequence(first, last)))
    here = F.least(F.col("__from") + F.col("__paged_n"), (F.col("__page") + 1) * F.col("__per")) - F.greatest(F.col("__from"), F.col("__page") * F.col("__per"))
    pages = pages.withColumn("__here", here)
    filled = F.least(F.col("__leaf") - F.col("__page") * F.col("__per") * F.col("__bytes"), F.col("__per") * F.col("__bytes"))
    return (pages.withColumn("__shard_bytes", filled.cast("bigint")).repartition("__h", "__page")
            .withColumn("__i", F.explode(F.expr("array_repeat(1, int(__here))"))).select(*names, "__page", "__shard_bytes"))


def oracle(limit: int = LIMIT) -> str:
    """The same shards in SQL: every prefix length for every row, the shortest that fits."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                      ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents),
    up AS (SELECT d.*, k.range::INTEGER AS depth, h >> ({BITS} - k.range)::BIGINT AS prefix FROM d, range(0, {BITS + 1}) k),
    sums AS (SELECT depth, prefix, sum(bytes)::BIGINT AS b FROM up GROUP BY ALL
             HAVING sum(bytes) <= {limit} OR min(h) = max(h)),
    best AS (SELECT doc_id, h, bytes, min(depth) AS depth FROM up SEMI JOIN sums USING (depth, prefix) GROUP BY ALL)
    SELECT best.doc_id, best.bytes, best.depth, s.prefix, 0::BIGINT AS page, s.b AS shard_bytes
    FROM best JOIN sums s ON s.depth = best.depth AND s.prefix = best.h >> ({BITS} - best.depth)::BIGINT"""

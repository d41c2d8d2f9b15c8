"""Mixing sources to target weights by systematic sampling.

A document's expected number of copies is its source's target over its source's size. Within
a source, the running sum of expected copies plus one random offset is cut at whole numbers;
a document is written once per boundary it crosses. The running sum needs ranks only: counts
per cell of (source, size class of an eighth of an octave, hash prefix) give each cell's first rank, so a source of any
size is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix"


def n_words(text) -> Column:
    """Number of runs of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\u000b\f\r"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """`sizes` (source, source_size: a row per source) with `target` and `rate`.

    Sources by code point, null last, weigh `weights`, repeating. All sizes are shared out by
    weight; a target stops at `cap` times its source's size and the excess goes to the others.
    Solved in one pass: in order of size per weight, the first source that its share does not
    fill fixes the share per unit of weight. An empty source has target and rate 0.
    """
    k = len(weights)
    alone = W.orderBy(F.col("source").isNull(), "source")          # a row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(alone) - 1) % k + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(cap))
    by = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    df = (df.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("share", F.col("left") / F.sum("w").over(after))
          .withColumn("at", F.row_number().over(by))
          .withColumn("at", F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("at")))
          .withColumn("share", F.min_by("share", "at").over(every)))
    target = F.least(F.col("cap"), F.coalesce(F.col("share"), F.lit(0.0)) * F.col("w"))
    return df.select("source", "source_size", target.alias("target"),
                     F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED,
        source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with __size, __source_size, __target and __copies (how often the mix takes the row).

    A null text counts no words; a null source is a source of its own; rows with a null or a
    repeated key are ranked like any other. Size classes come first in the order, so copies are
    spread over short and long documents alike. Reruns agree: order and offset are hashes.
    An empty table gives an empty result.
    """
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    df = (docs.withColumn("__size", n_words(F.col(text)))
          .withColumn("__s", F.coalesce(F.col(source), F.lit(""))).withColumn("__null", F.col(source).isNull())
          .withColumn("__class", F.concat(F.lpad(F.length(F.bin("__size")).cast("string"), 2, "0"), F.substring(F.bin("__size"), 1, 4)))
          .withColumn("__h", h)
          .withColumn("__part", F.substring("__h", 1, 2)))
    cell = ["__s", "__null", "__class", "__part"]
    cells = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    per = cells.groupBy("__s", "__null").agg(F.sum("__words").alias("source_size"))
    per = targets(per.select(F.when(~F.col("__null"), F.col("__s")).alias("source"), "source_size"), weights, cap)
    per = per.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__null"),
                     F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    order = W.partitionBy("__s", "__null").orderBy("__class", "__part")
    cells = (cells.withColumn("__first", F.sum("__n").over(order) - F.col("__n"))
             .join(per, ["__s", "__null"]).drop("__n", "__words"))
    inside = W.partitionBy(*cell).orderBy("__size", "__h", key)
    # Twenty bits: the running sum stays exact for billions of documents.
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__s").cast("binary")), 1, 5), 16, 10).cast("double") / (1 << 20)
    rank = (F.col("__first") + F.row_number().over(inside)).cast("double")
    df = df.join(cells, cell).withColumn("__rank", rank).withColumn("__u", u)
    crossed = F.floor(F.col("__rank") * F.col("__rate") + F.col("__u")) - F.floor((F.col("__rank") - 1) * F.col("__rate") + F.col("__u"))
    return df.withColumn("__copies", crossed.cast("bigint")).drop(*cell, "__h", "__first", "__rate", "__rank", "__u")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it."""
    out = mix(docs, **how).filter("__copies > 0")
    return out.withColumn("__i", F.explode(F.expr("array_repeat(1, int(__copies))"))).select(*docs.columns)


def oracle(weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED) -> str:
    """The same mix in SQL, with plain ranks."""
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
    w AS (SELECT *, {list(map(float, weights))}[(r - 1) % {len(weights)} + 1]::DOUBLE AS w, s * {cap}.0::DOUBLE AS cap FROM per),
    sh AS (SELECT *, row_number() OVER o AS i, ((SELECT sum(s) FROM w)
               - coalesce(sum(cap) OVER (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY s / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
           FROM w WINDOW o AS (ORDER BY s / w, r)),
    unit AS (SELECT coalesce(arg_min(share, i), 0) AS share FROM sh WHERE share * w <= cap),
    t AS (SELECT w.source, w.s, least(cap, unit.share * w) AS target FROM w, unit),
    ranked AS (SELECT d.*, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), substr(bin(size), 1, 4),
            substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, md5(coalesce(doc_id::VARCHAR, '')), doc_id)::DOUBLE AS rank,
        ('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(d.source, ''))), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
    SELECT doc_id, size, s AS source_size, target::DOUBLE AS target,
           (size * (floor(rank * rate + u) - floor((rank - 1) * rate + u)))::BIGINT AS taken FROM ranked"""

"""Intervals from resampled owners, computed on sums per owner.

Rows of one owner are not independent, so owners are drawn, with replacement and as many as there
are. An owner's weights in all draws are one vector of bytes, made once and carried on the owner's
rows; sums of all draws are taken map-side, as vectors. No row per owner and draw is ever formed.

The scheme is the same at any number of owners: owners fall into buckets by a hash of their name, the driver
deals each draw's total over the buckets (a multinomial on their sizes), and each bucket deals its share
over its owners. Both are seeded by (seed, draws, bucket): the same owners get the same draws in any
partitioning and for every model.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.concordance import as_points, concordance, pair_sums
from ebbtide.operators.metrics import log_error, log_errors
from ebbtide.session import cut_lineage

BUCKET_OWNERS = 2_000       # owners of a bucket, about
MAX_BUCKETS = 4_096         # beyond it buckets hold more owners; the driver holds buckets x draws numbers


def _deal(seed: int, draws: int, shares: np.ndarray):
    """A bucket's (owner, w): its share of every draw dealt evenly over its owners."""
    def run(key, table):
        bucket, names = key[0].as_py(), sorted(table.column("owner").to_pylist())
        rng = np.random.default_rng([seed, draws, bucket + 1])
        w = rng.multinomial(shares[:, bucket], np.full(len(names), 1 / len(names)))           # draws x owners
        if w.max(initial=0) > 255:
            raise ValueError("an owner is drawn more than 255 times")
        return pa.table({"owner": pa.array(names, pa.string()), "w": pa.array([r.tobytes() for r in w.T.astype(np.uint8)], pa.binary())})
    return run


def owner_vectors(owners: DataFrame, draws: int, seed: int) -> DataFrame:
    """(owner, w): how often each owner occurs in each draw, a byte per draw. Every draw adds up to the number of owners."""
    o = owners.select(F.col("owner").cast("string").alias("owner")).filter(F.col("owner").isNotNull()).distinct()
    o = cut_lineage(o)
    k = o.count()
    buckets = min(MAX_BUCKETS, max(1, -(-k // BUCKET_OWNERS)))
    o = o.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets)
    for bucket, n in o.groupBy("bucket").count().collect():                                   # a row per bucket
        sizes[bucket] = n
    shares = np.random.default_rng([seed, draws, 0]).multinomial(k, sizes / max(k, 1), draws) if k else np.zeros((draws, buckets), int)
    return o.groupBy("bucket").applyInArrow(_deal(seed, draws, shares), "owner string, w binary")


def owner_weights(owners: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, owner, w) with w > 0: `owner_vectors` spelled out, for a look at small tables."""
    w = owner_vectors(owners, draws, seed).select("owner", F.posexplode(F.split(F.regexp_replace(F.hex("w"), "(..)", "$1,"), ",")).alias("draw", "x"))
    return w.filter("x <> ''").select("draw", "owner", F.conv("x", 16, 10).cast("long").alias("w")).filter("w > 0")


def drawn_sums(per: DataFrame, keys: list[str], sums: list[str], draws: int) -> DataFrame:
    """(keys, draw, sums): each draw's weighted totals of `per` (keys, owner's sums, w). A task adds up its owners first."""
    schema = ", ".join([*[f"`{k}` {per.schema[k].dataType.simpleString()}" for k in keys], "draw int", *[f"`{x}` double" for x in sums]])

    def run(batches):
        totals: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            w = np.frombuffer(b"".join(b.column("w").to_pylist()), np.uint8).reshape(-1, draws).astype(float)
            x = np.column_stack([np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in sums])
            names = list(zip(*[b.column(k).to_pylist() for k in keys])) if keys else [()] * b.num_rows
            ids: dict = {}
            at = np.array([ids.setdefault(v, len(ids)) for v in names])
            for v, i in ids.items():
                totals[v] = totals.get(v, 0) + w[at == i].T @ x[at == i]
        for v, t in totals.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([c] * draws, kinds[k]) for k, c in zip(keys, v)], pa.array(np.arange(draws, dtype=np.int32)), *map(pa.array, t.T.copy())],
                                             [*keys, "draw", *sums])

    kinds = {k: pa.string() for k in keys}
    return per.select(*keys, *sums, "w").mapInArrow(run, schema).groupBy(*keys, "draw").agg(*[F.sum(x).alias(x) for x in sums])


def owner_bootstrap(df: DataFrame, sums: dict[str, Column], stats: Callable[[], dict[str, Column]],
                    draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Point estimate and percentile interval of each statistic: name, point, low, high.

    `sums` are per-row terms to add up; `stats` gives expressions over their totals.
    """
    per = df.groupBy(F.col("owner").cast("string").alias("owner")).agg(*[F.sum(v.cast("double")).alias(k) for k, v in sums.items()])
    drawn = drawn_sums(per.join(owner_vectors(per, draws, seed), "owner"), [], list(sums), draws)
    named = stats()
    point = per.agg(*[F.sum(k).alias(k) for k in sums]).select(*[v.alias(n) for n, v in named.items()])
    rows = drawn.select(*[v.alias(n) for n, v in named.items()])
    ci = rows.agg(*[F.percentile(n, [alpha / 2, 1 - alpha / 2]).alias(f"_{n}") for n in named])
    j = point.crossJoin(ci)                                                       # one row by one row
    return j.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("point"),
                 F.col(f"_{n}")[0].alias("low"), F.col(f"_{n}")[1].alias("high"))
        for n in named])).alias("s")).select("s.*")


def flag_bootstrap(flagged: DataFrame, fast: str, draws: int, seed: int) -> DataFrame:
    """Intervals for a fixed flag: precision, base rate, recall and their difference."""
    y, f = F.col(fast).cast("int"), F.col("flagged").cast("int")
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return owner_bootstrap(
        flagged, {"n": F.lit(1), "y": y, "f": f, "fy": f * y},
        lambda: {"precision": ratio("fy", "f"), "base_rate": ratio("y", "n"), "recall": ratio("fy", "y"),
                 "precision_minus_base": ratio("fy", "f") - ratio("y", "n")}, draws, seed)


def concordance_draws(stacked: DataFrame, draws: int, seed: int) -> DataFrame:
    """C-index and MAE of every model in every draw, all models on the same draws. Both are exact at any size."""
    d = stacked.withColumn("owner", F.col("owner").cast("string"))
    w = cut_lineage(owner_vectors(d, draws, seed))
    points = as_points(d, "duration", "event", "predicted", ["model"], ("owner",)).join(w, "owner").drop("owner")
    c = pair_sums(points, draws).select(F.get_json_object("top", "$.model").alias("model"), "draw",
                                        ((F.col("less") + F.col("equal") / 2) / F.nullif("pairs", F.lit(0.0))).alias("c_index"))
    per = (d.filter("event").groupBy("model", "owner").agg(F.sum(F.abs(log_error())).alias("s"), F.count(F.lit(1)).alias("k")))
    mae = drawn_sums(per.join(w, "owner"), ["model"], ["s", "k"], draws).select("draw", "model", (F.col("s") / F.nullif("k", F.lit(0.0))).alias("mae_log10"))
    return c.join(mae, ["draw", "model"], "left")


def score_models(stacked: DataFrame) -> DataFrame:
    """Exact C-index, MAE and RMSE per model, all models in one pass."""
    c = concordance(stacked, by=["model"]).select("model", "c_index", "pairs")
    return c.join(log_errors(stacked, ["model"]), "model", "left")


def bootstrap_ci(scores: DataFrame, drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per model: C-index and MAE with the intervals of resampled owners."""
    q = [alpha / 2, 1 - alpha / 2]
    ci = drawn.groupBy("model").agg(F.percentile("c_index", q).alias("c"), F.percentile("mae_log10", q).alias("m"))
    return scores.join(ci, "model").select(
        "model", "c_index", F.col("c")[0].alias("c_low"), F.col("c")[1].alias("c_high"),
        "mae_log10", F.col("m")[0].alias("mae_low"), F.col("m")[1].alias("mae_high"), "rmse_log10")


def paired_delta_bootstrap(scores: DataFrame, drawn: DataFrame, pairs: list[tuple[str, str]],
                           alpha: float = 0.05) -> DataFrame:
    """Model minus baseline on the same draws: differences, intervals, share of draws ahead."""
    pt = scores.sparkSession.createDataFrame(pairs, "model string, baseline string")
    x = drawn.select("draw", "model", F.col("c_index").alias("ca"), F.col("mae_log10").alias("ma"))
    y = drawn.select("draw", F.col("model").alias("baseline"), F.col("c_index").alias("cb"), F.col("mae_log10").alias("mb"))
    j = pt.join(x, "model").join(y, ["draw", "baseline"]).filter(F.col("ca").isNotNull() & F.col("cb").isNotNull())
    q = [alpha / 2, 1 - alpha / 2]
    dc, dm = F.col("ca") - F.col("cb"), F.col("ma") - F.col("mb")
    ci = j.groupBy("model", "baseline").agg(
        F.count(F.lit(1)).alias("draws"), F.percentile(dc, q).alias("c"), F.percentile(dm, q).alias("m"),
        F.avg((dc > 0).cast("double")).alias("share_draws_ahead"))
    s = scores.select("model", "c_index", "mae_log10")
    b = scores.select(F.col("model").alias("baseline"), F.col("c_index").alias("cb"), F.col("mae_log10").alias("mb"))
    return (ci.join(s, "model").join(b, "baseline").select(
        "model", "baseline", "draws", (F.col("c_index") - F.col("cb")).alias("delta_c_index"),
        F.col("c")[0].alias("delta_c_low"), F.col("c")[1].alias("delta_c_high"), "share_draws_ahead",
        (F.col("mae_log10") - F.col("mb")).alias("delta_mae_log10"),
        F.col("m")[0].alias("delta_mae_low"), F.col("m")[1].alias("delta_mae_high")))

"""Median of everything an owner did before, at each point in time.

Order statistics of all prefixes of a series come from a wavelet matrix over its ranks: a bit per
level, and for every prefix at once the number of zeros decides on which side its median lies; a task
takes the owners it was dealt many at once, each a range of one such matrix. An
owner with more rows than one task takes is cut along time; each piece then also
receives the few earlier values that can still be its median. Those are found
from counts per (piece, value bucket), so no piece sees the whole history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.chunks import whole_groups
from ebbtide.operators.skew import SEG, split_hot

HISTORY_ROWS = 500_000


def range_quantiles(ranks: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 0) of the entries `left` to `right` (exclusive) of `ranks`, a permutation."""
    out = np.zeros(len(k), np.int64)
    for bit in range(max(1, int(len(ranks) - 1).bit_length()) - 1, -1, -1):
        one = (ranks >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        zl, zr = zeros[left], zeros[right]
        low = k < zr - zl
        out |= np.where(low, 0, 1 << bit)
        k = np.where(low, k, k - (zr - zl))
        left, right = np.where(low, zl, zeros[-1] + left - zl), np.where(low, zr, zeros[-1] + right - zr)
        ranks = np.concatenate((ranks[one == 0], ranks[one == 1]))
    return out


def prefix_quantiles(ranks: np.ndarray, length: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 0) of the first `length` entries of `ranks`, a permutation."""
    return range_quantiles(ranks, np.zeros(len(k), np.int64), length, k)


def grouped_medians(values: np.ndarray, ctx: np.ndarray, starts: np.ndarray, below: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median of prior values, their number) ahead of each value, for many groups at once.

    A group begins at each of `starts`, with its rows of `ctx` first: the earlier values that matter. `below` says, on
    every row of a group, how many smaller ones were left out, `earlier` how many there were in all. NaN entries add
    nothing, no prior value gives NaN.
    """
    sizes = np.diff(np.append(starts, len(values)))
    known = ~np.isnan(values)
    pos = np.cumsum(known) - known                                    # known rows before each row, over all groups
    left = np.repeat(pos[starts], sizes)
    c = np.cumsum(ctx & known)
    inside = c - np.repeat(c[starts] - (ctx & known)[starts], sizes)  # those of the group's own context
    n = earlier + pos - left - inside
    series = values[known]
    out, ask = np.full(len(values), np.nan), np.flatnonzero((n > 0) & ~ctx)
    if len(ask):
        order = np.argsort(series, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        m = n[ask]
        lo, hi = (series[order[range_quantiles(ranks, left[ask], pos[ask], k - below[ask])]] for k in ((m - 1) // 2, m // 2))
        out[ask] = np.where(lo == hi, lo, (lo + hi) / 2.0)
    return out, n


def prior_medians(values: np.ndarray, before: np.ndarray, below: int, earlier: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one group: `before` holds the earlier values that matter."""
    k, n = len(before), len(before) + len(values)
    if not n:
        return np.empty(0), np.empty(0, np.int64)
    median, seen = grouped_medians(np.concatenate((before, values)), np.arange(n) < k, np.zeros(1, np.int64), np.full(n, below), np.full(n, earlier))
    return median[k:], seen[k:]


def _per_pieces(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Medians of groups that come with their context first."""
    num = lambda c: t.column(c).to_numpy()
    ctx = num("_ctx").astype(bool)
    median, n = grouped_medians(t.column("v").to_pandas().to_numpy(float), ctx, starts, num("_below"), num("_earlier"))
    own = ~ctx
    return pa.RecordBatch.from_arrays([t.column("entity").filter(pa.array(own)).combine_chunks(), pa.array(median[own], pa.float64(), from_pandas=True),
                                       pa.array(n[own], pa.int64())], ["entity", "prior_median", "n_prior"])


def _medians(rows: DataFrame) -> DataFrame:
    """Medians per (owner, _t): groups are dealt over tasks and sorted there, and a task takes many at once."""
    rows = rows.select("owner", "_t", "entity", "_at", "v", "_ctx", "_below", "_earlier").repartition("owner", "_t")
    rows = rows.sortWithinPartitions("owner", "_t", F.desc("_ctx"), "_at", F.asc_nulls_last("entity"))
    return rows.mapInArrow(whole_groups(_per_pieces, ["owner", "_t"]), "entity string, prior_median double, n_prior bigint")


def prior_median(df: DataFrame, value: str, max_rows: int | None = None) -> DataFrame:
    """Per entity: median and count of `value` over the owner's earlier entities.

    Earlier is by (published_at, entity), so ties in time have a fixed order.
    """
    r = df.filter(F.col("owner").isNotNull() & F.col("published_at").isNotNull()).select(
        "owner", "entity", F.unix_micros(F.col("published_at").cast("timestamp")).alias("_at"),
        F.col(value).cast("double").alias("v"))
    g = split_hot(r, ["owner"], "_at", max_rows)
    plain = dict(_t=F.lit(0), _below=F.lit(0).cast("bigint"), _earlier=F.lit(0).cast("bigint"), _ctx=F.lit(False))
    if not g.hot:
        return _medians(g.df.withColumns(plain))

    rows = g.df.withColumnRenamed(SEG, "_t")
    own = rows.withColumns({"_ctx": F.lit(False)})
    known = rows.filter((F.col("_t") >= 0) & F.col("v").isNotNull())
    cut = split_hot(known, ["owner"], "v", max_rows or HISTORY_ROWS)
    known = cut.df.withColumnRenamed(SEG, "_b") if cut.hot else cut.df.withColumn("_b", F.lit(0))
    cells = known.groupBy("owner", "_t", "_b").agg(F.count(F.lit(1)).alias("c"))
    span = cells.groupBy("owner").agg(F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.max("_b").alias("b1"),
                                      F.min("_b").alias("b0"))
    grid = (span.select("owner", F.explode(F.sequence("t0", "t1")).alias("_t"), "b0", "b1")
            .select("owner", "_t", F.explode(F.sequence("b0", "b1")).alias("_b"))
            .join(cells, ["owner", "_t", "_b"], "left"))
    w_time = Window.partitionBy("owner", "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    w_val = Window.partitionBy("owner", "_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy("owner", "_t")
    p = (grid.withColumn("p", F.coalesce(F.sum("c").over(w_time), F.lit(0)))
         .withColumns({"top": F.sum("p").over(w_val), "n0": F.sum("p").over(w_all),
                       "m": F.coalesce(F.sum("c").over(w_all), F.lit(0))})
         .withColumn("bottom", F.col("top") - F.col("p")))
    reach = F.col("m") / 2 + 2
    need = p.filter((F.col("p") > 0) & (F.col("bottom") <= F.col("n0") / 2 + reach)
                    & (F.col("top") > F.col("n0") / 2 - reach))
    meta = (p.groupBy("owner", "_t").agg(F.max("n0").alias("_earlier"))
            .join(need.groupBy("owner", "_t").agg(F.min("bottom").alias("_below")), ["owner", "_t"], "left"))
    own = (own.join(meta, ["owner", "_t"], "left")
           .withColumns({"_below": F.coalesce("_below", F.lit(0)).cast("bigint"),
                         "_earlier": F.coalesce("_earlier", F.lit(0)).cast("bigint")}))
    ctx = (known.alias("k").join(need.select("owner", "_b", F.col("_t").alias("_to")), ["owner", "_b"])
           .filter(F.col("_t") < F.col("_to"))
           .select("owner", F.lit(None).cast("string").alias("entity"), F.lit(0).cast("bigint").alias("_at"),
                   "v", F.col("_to").alias("_t"), F.lit(True).alias("_ctx"),
                   F.lit(0).cast("bigint").alias("_below"), F.lit(0).cast("bigint").alias("_earlier")))
    return _medians(own.unionByName(ctx))

"""Harrell's C without forming pairs, for one or many sets of weights.

A pair (i, j) is comparable when i's event was seen and i's time comes first, a
censored j at the same time included. It is concordant when i's prediction is the
smaller one, and half so at equal predictions.

A group of points that fits a task is counted there, by products of small matrices. A larger one is
placed on a grid of time and prediction buckets: whole blocks of the grid are counted from cell
totals, and what remains are pairs inside one time bucket or inside one prediction bucket. Each
such bucket is a group again, counted or split by the same rule, until all fit. A value common enough to be
a bucket edge gets a bucket of its own, where the count is closed-form; so groups always
shrink. The result is exact at any size.

Every point carries a vector of weights, one per draw; a plain count is one draw of weight 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

LEAF_ROWS = 200_000     # points that one task counts
FANOUT = 32             # buckets per axis of a split: at most 96 x 64 cells a group
FEW_GROUPS = 1_000      # oversized groups whose bucket edges are sent to all tasks; beyond that they are joined
SLICE = 200             # draws that one task counts; a group's points go to each of its slices, with that part of their weights
AT_ONCE = 8_000_000     # weights of a block of draws

TILE, FAN = 128, 64     # points whose pairs are counted by a matrix product; children of a block

class PairCounts:
    """Weighted counts over pairs with t_i < t_j.

    Points must be distinct in (t, p). `less`, `equal` and `total` sum
    wi_i * wj_j over pairs by how p_i compares with p_j; weights with a second axis (draws) give
    a sum for each draw.

    Points lie in order of time. Pairs inside a tile of them are counted by a product with the tile's 0/1 matrix. A block
    of `FAN` tiles, then of `FAN` blocks, is put in order of prediction: pairs from different children are
    counted by totals per (tile, child), and inside a tile by its matrix again. All sums are of whole numbers.
    """

    def __init__(self, t: np.ndarray, p: np.ndarray):
        _, self.t = np.unique(t, return_inverse=True)
        _, self.p = np.unique(p, return_inverse=True)
        # Descending p inside equal t: such pairs then add nothing to `less`.
        self.order = np.lexsort((-self.p, self.t))
        self.t, self.p = self.t[self.order], self.p[self.order]
        n = len(self.t)
        by_p = np.lexsort((-np.arange(n), self.p))                    # equal predictions never rise along time
        self.rank = np.arange(-(-n // TILE) * TILE)
        self.rank[by_p] = np.arange(n)
        pos, size, self.levels = np.arange(len(self.rank)), TILE, []
        while size < n:
            o = np.lexsort((self.rank, pos // (size * FAN)))
            self.levels.append((o, o // size % FAN, size * FAN))
            size *= FAN

    def _below(self, wi: np.ndarray, wj: np.ndarray, key: np.ndarray, block: int = 0) -> np.ndarray:
        """Sums over pairs of rows i before j with key_i < key_j, inside tiles, or inside blocks if the keys are children."""
        earlier, kids, out, kind = np.tri(TILE, k=-1, dtype=bool), np.arange(FAN)[None, :, None], np.zeros(wi.shape[1]), wi.dtype
        for s in range(0, len(key), TILE * FAN):
            k, a, b = (x[s:s + TILE * FAN].reshape(-1, TILE, *x.shape[1:]) for x in (key, wi, wj))
            out += np.multiply(b, ((k[:, :, None] > k[:, None, :]) & earlier).astype(kind) @ a, dtype=float).sum(axis=(0, 1))
            if block:
                carry = 0.0 if s % block == 0 else carry              # noqa: F821
                below = (k[:, None, :] < kids).astype(kind) @ a
                upto = np.cumsum(below, axis=0, dtype=float) + carry
                out += ((upto - below) * ((k[:, None, :] == kids).astype(kind) @ b)).sum(axis=(0, 1))
                carry = upto[-1]
        return out

    def count(self, wi: np.ndarray, wj: np.ndarray) -> tuple:
        if wi.ndim == 1:
            return tuple(x[0] for x in self.count(wi[:, None], wj[:, None]))
        n, draws = wi.shape
        fill = ((0, len(self.rank) - n), (0, 0))
        # A tile's sums of small whole numbers are exact in single precision.
        kind = np.float32 if max(wi.max(initial=0), wj.max(initial=0)) * TILE < 1 << 24 else np.float64
        wi, wj = np.pad(wi[self.order].astype(kind), fill), np.pad(wj[self.order].astype(kind), fill)
        less = self._below(wi, wj, self.rank)
        for o, child, block in self.levels:
            less += self._below(wi[o], wj[o], child, block)
        wi, wj, zero, equal = wi[:n].astype(float), wj[:n].astype(float), np.zeros((1, draws)), np.zeros(draws)
        o = np.argsort(self.p, kind="stable")
        p = self.p[o]
        tied = np.append(p[1:] == p[:-1], False) | np.append(False, p[1:] == p[:-1])
        if tied.any():
            o, p = o[tied], p[tied]
            cum = np.concatenate((zero, np.cumsum(wi[o], axis=0)))
            equal = (wj[o] * (cum[:-1] - cum[np.searchsorted(p, p, side="left")])).sum(axis=0)
        before = np.concatenate((zero, np.cumsum(wi, axis=0)))
        start = np.searchsorted(self.t, self.t, side="left")
        return less, equal, (wj * before[start]).sum(axis=0)


def _ranks(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rank of (time, censored): at one time the events come first."""
    o = np.lexsort((c, t))
    step = np.concatenate(([0], ((t[o][1:] != t[o][:-1]) | (c[o][1:] != c[o][:-1])).astype(int)))
    out = np.empty(len(o), int)
    out[o] = np.cumsum(step)
    return out


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values


def _matrix(column, draws: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, draws)


_OUT = "top string, draw int, pairs double, less double, equal double"


def _result(top, pairs, less, equal, first: int = 0) -> pa.Table:
    n = len(less)
    return pa.table({"top": pa.array([top] * n, pa.string()), "draw": pa.array(np.arange(first, first + n, dtype=np.int32)),
                     **{k: pa.array(np.asarray(v, float)) for k, v in (("pairs", pairs), ("less", less), ("equal", equal))}})


def _leaf(table: pa.Table) -> pa.Table:
    """All pairs of one group of points, in a slice of the draws that begins with `at`."""
    t, c, p, e, n = (table.column(x).to_numpy() for x in ("t", "c", "p", "e", "n"))
    draws = len(table.column("w")[0].as_py())
    w, r = _matrix(table.column("w"), draws, np.uint8), _ranks(t, c)
    o = np.lexsort((p, r))
    new = np.ones(len(o), bool)
    new[1:] = (r[o][1:] != r[o][:-1]) | (p[o][1:] != p[o][:-1])
    starts = np.flatnonzero(new)
    k = PairCounts(r[o][starts], p[o][starts])
    step = max(1, AT_ONCE // len(o))
    parts = [k.count(_summed(w[o, a:a + step] * e[o, None], starts), _summed(w[o, a:a + step] * n[o, None], starts)) for a in range(0, draws, step)]
    less, equal, pairs = (np.concatenate([x[i] for x in parts]) for i in range(3))
    return _result(table.column("top")[0].as_py(), pairs * table.column("full")[0].as_py(), less, equal, table.column("at")[0].as_py())


def _cells(draws: int):
    """Weights of a task's points per cell."""
    def run(batches):
        for b in batches:
            names: dict = {}
            ids = np.array([names.setdefault(x, len(names)) for x in zip(*[b.column(c).to_pylist() for c in ("top", "g", "full", "tb", "pb")])], int)
            o = np.argsort(ids, kind="stable")
            starts = np.flatnonzero(np.append(True, ids[o][1:] != ids[o][:-1])) if len(o) else np.empty(0, int)
            w, e, n = _matrix(b.column("w"), draws, np.uint8), b.column("e").to_numpy(), b.column("n").to_numpy()
            es, ns = _summed(w[o] * e[o, None], starts), _summed(w[o] * n[o, None], starts)
            keys = list(zip(*names)) if names else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k, t) for k, t in zip(keys, kinds)], *[pa.array([r.astype(np.int64).tobytes() for r in v], pa.binary()) for v in (es, ns)]],
                ["top", "g", "full", "tb", "pb", "es", "ns"])
    return run


def _cell_sums(draws: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        for x in ("es", "ns"):
            total = _matrix(table.column(x), draws, np.int64).sum(axis=0)
            first = first.set_column(first.column_names.index(x), x, pa.array([total.tobytes()], pa.binary()))
        return first
    return run


def _blocks(draws: int):
    """Pairs from different time buckets that lie in different prediction buckets, or in one that holds a single value."""
    def run(table: pa.Table) -> pa.Table:
        tb, pb = table.column("tb").to_numpy(), table.column("pb").to_numpy()
        e, n = (_matrix(table.column(x), draws, np.int64) for x in ("es", "ns"))
        less, _, pairs = PairCounts(tb, pb).count(e, n)
        odd, equal = pb % 2 == 1, np.zeros(draws)
        if odd.any():
            equal = PairCounts(tb[odd], pb[odd]).count(e[odd], n[odd])[1]
        return _result(table.column("top")[0].as_py(), pairs * table.column("full")[0].as_py(), less, equal)
    return run


def _bucket(x: str, edges: str):
    """(number of edges below, sits on an edge): edge values are buckets of their own."""
    below = F.size(F.filter(edges, lambda e: e < F.col(x)))
    return below, F.coalesce(F.get(edges, below) == F.col(x), F.lit(False))


def _split(d: DataFrame, groups: int, fanout: int) -> DataFrame:
    """Points with the buckets `tb` and `pb` of their group; edges are quantiles of the group's points."""
    at = [i / fanout for i in range(1, fanout)]
    edges = d.groupBy("g").agg(*[F.sort_array(F.array_distinct(F.percentile_approx(x, at, 10_000))).alias(f"_{x}") for x in "tp"])
    d = d.join(F.broadcast(edges) if groups <= FEW_GROUPS else edges, "g")
    (tb, t_on), (pb, p_on) = _bucket("t", "_t"), _bucket("p", "_p")
    # A time on an edge splits into its events, then its censored rows.
    return d.withColumns({"tb": (tb * 3 + F.when(t_on, F.col("c") + 1).otherwise(0)).cast("int"), "pb": (pb * 2 + p_on.cast("int")).cast("int")}).drop("_t", "_p")


def pair_sums(points: DataFrame, draws: int = 1, buckets: int | None = None) -> DataFrame:
    """(top, draw, pairs, less, equal) over the comparable pairs of each `top`.

    `points`: top, t, c (1 if censored), p, e (events), n (rows), w (a byte per draw). Any number of tops;
    `buckets` forces a first split into as many buckets per axis.
    """
    work = cut_lineage(points.withColumns({"g": F.col("top"), "full": F.lit(1)}))
    fanout, limit, parts = buckets or FANOUT, LEAF_ROWS if not buckets or buckets == 1 else 1, []
    columns = ["top", "g", "full", "t", "c", "p", "e", "n", "w"]
    while True:
        sizes = cut_lineage(work.groupBy("g").count().filter(F.col("count") > limit).select("g"))
        groups = sizes.count()
        few = F.broadcast(sizes) if groups <= FEW_GROUPS else sizes
        rest = work if not groups else work.join(few, "g", "left_anti")
        sliced = rest.select(columns).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(SLICE))))
        sliced = sliced.withColumn("w", F.substr("w", F.col("at") + 1, F.lit(SLICE)))
        parts.append(sliced.groupBy("g", "at").applyInArrow(_leaf, _OUT))
        if not groups:
            break
        d = cut_lineage(_split(work.join(few, "g", "left_semi"), groups, max(2, fanout)))
        kind = "top string, g string, full int, tb int, pb int, es binary, ns binary"
        cells = d.mapInArrow(_cells(draws), kind).groupBy("g", "tb", "pb").applyInArrow(_cell_sums(draws), kind)
        parts.append(cells.groupBy("g").applyInArrow(_blocks(draws), _OUT))
        inside = lambda axis, **new: (d.filter(F.col(f"{axis}b") % (3 if axis == "t" else 2) == 0)
                                      .withColumns({"g": F.concat_ws("/", "g", F.lit(axis), f"{axis}b"), **new}).select(columns))
        # Inside one prediction bucket only pairs from different time buckets are left, and their number is counted above.
        work = cut_lineage(inside("t").unionByName(inside("p", t=F.col("tb").cast("double"), c=F.lit(0), full=F.lit(0))))
        fanout, limit = FANOUT, LEAF_ROWS
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("top", "draw").agg(*[F.sum(x).alias(x) for x in ("pairs", "less", "equal")])


def as_points(df: DataFrame, time: str, event: str, predicted: str, by: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct points with their numbers of rows and events."""
    top = F.to_json(F.struct(*by)) if by else F.lit("")
    d = (df.filter(F.col(time).isNotNull() & F.col(predicted).isNotNull())
         .groupBy(top.alias("top"), *more, F.col(time).cast("double").alias("t"), (~F.col(event).cast("boolean")).cast("int").alias("c"),
                  F.col(predicted).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n")))
    return d.withColumn("e", F.when(F.col("c") == 0, F.col("n")).otherwise(0))


def concordance(df: DataFrame, time: str = "duration", event: str = "event", predicted: str = "predicted",
                by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Comparable pairs, concordant, tied, and the C-index (null without pairs), per group."""
    by = list(by)
    s = pair_sums(as_points(df, time, event, predicted, by).withColumn("w", F.lit(bytearray(b"\x01"))), buckets=buckets)
    got = s.select("top", F.col("pairs").cast("bigint").alias("pairs"), F.col("less").cast("bigint").alias("concordant"),
                   F.col("equal").cast("bigint").alias("tied"),
                   ((F.col("less") + F.col("equal") / 2) / F.nullif("pairs", F.lit(0.0))).alias("c_index"))
    if not by:
        return got.drop("top")
    return df.select(F.to_json(F.struct(*by)).alias("top"), *by).distinct().join(got, "top").drop("top")

"""Exact top-k by inner product: a Voronoi kNN join.

Pivots from a bounded sample split the vectors into cells. A cell's summary (number of rows, largest
distance from its pivot) bounds every inner product with its rows from both sides:
`q.p - |q| r <= q.x <= q.p + |q| r`. Lower bounds of the fullest certain cells give a query a
score that its k-th best row reaches at least; only cells whose upper bound reaches it get the
query. Each cell is solved on its own, large cells in blocks, so a cell may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
PIVOTS = 64             # bounded by parameter, like the sample that they come from
SAMPLE = 4096
ROUNDS = 5
BLOCK = 8192            # rows of a cell solved together
PORTION = 32_768        # queries of a cell solved together
QUERY_BLOCK = 1024
SLACK = 1e-6            # of rounding in the bounds, relative


def whole(vector) -> Column:
    """floor(256 x) of every component, or null if the vector or a component is null or not finite."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * SCALE).cast("double")))


def pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Centres of a few rounds of k-means, started from spread-out rows of the sample."""
    if len(sample) <= n:
        return np.unique(sample, axis=0)
    at, far = [0], np.full(len(sample), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
        if far.max() == 0:
            break
        at.append(int(far.argmax()))
    p = sample[at]
    for _ in range(ROUNDS):
        near = _nearest(sample, p)
        p = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((p ** 2).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _assign(p: np.ndarray):
    """(id, cell, distance from its pivot, vector)."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), p.shape[1])
            cell = _nearest(x, p)
            r = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(r), b.column(1)], ["id", "cell", "r", "x"])
    return run


def visits(q: np.ndarray, p: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: which cells may hold one of the k best rows of each query.

    `own` has, for each query and cell, the number of rows with the query's key, which are no answers.
    """
    centre, spread = q @ p.T, np.sqrt((q ** 2).sum(axis=1))[:, None] * radius[None, :]
    slack = SLACK * (1 + np.abs(centre) + spread)
    low, high = centre - spread - slack, centre + spread + slack
    order = np.argsort(-low, axis=1)
    left = np.broadcast_to(rows, low.shape) - (0 if own is None else own)
    enough = np.cumsum(np.take_along_axis(left, order, 1), axis=1) >= k
    first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(p) - 1)
    kth = np.take_along_axis(low, np.take_along_axis(order, first[:, None], 1), 1)
    kth = np.where(enough.any(axis=1)[:, None], kth, -np.inf)
    return (high >= kth) & (left > 0)


def _route(p, radius, rows, k):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), p.shape[1])
            own = np.zeros((len(x), len(p)))
            held = b.column(2)
            of = np.repeat(np.arange(len(x)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            pairs = held.flatten()
            own[of, pairs.field("cell").to_numpy()] = pairs.field("n").to_numpy()
            i, cell = np.nonzero(visits(x, p, radius, rows, k, own))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(cell.astype(np.int32)), b.column(1).take(pa.array(i))],
                                             ["qid", "cell", "q"])
    return run


def _solve(k: int, dim: int):
    """The k best rows of one block of a cell for every query sent there."""
    def run(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        q, x = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((queries, "q"), (data, "x")))
        qid, ids = queries.column("qid").to_numpy(), data.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = [[], [], []]
        for a in range(0, len(q), QUERY_BLOCK):
            s = (q[a:a + QUERY_BLOCK] @ x.T).round()                        # whole numbers below 2**53: exact
            s[qid[a:a + QUERY_BLOCK, None] == ids[None, :]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]             # ties: the smaller id comes first
            score = np.take_along_axis(s, best, 1)
            keep = np.isfinite(score)
            out[0].append(np.repeat(qid[a:a + QUERY_BLOCK], keep.sum(axis=1)))
            out[1].append(ids[best][keep])
            out[2].append(score[keep].astype(np.int64))
        cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "score": cat(out[2])})
    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best other rows of `data`.

    Score: inner product of floor(256 x) components; ties go to the smaller key; all rows if there
    are fewer than k. Rows with a null key, a null vector or a null or non-finite component take
    no part, nor do vectors without components or of another length than most (the longer, if
    two lengths are equally frequent). A key that data repeats is answered by each of its rows
    that is not the query's own key; a repeated query row gives one answer. Empty tables give no rows.
    """
    spark = data.sparkSession
    clean = lambda df: df.select(F.col(key).cast("long").alias("id"), whole(vector).alias("x")).filter("id IS NOT NULL AND size(x) > 0")
    rows, asked = clean(data), clean(queries).dropDuplicates(["id"])
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = lengths["d"]
    rows, asked = rows.filter(F.size("x") == dim), asked.filter(F.size("x") == dim)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()     # bounded by parameter
    p = pivots(np.array([r[0] for r in picked], float))
    cells = rows.mapInArrow(_assign(p), "id long, cell int, r double, x array<double>").checkpoint()
    summary = cells.groupBy("cell").agg(F.max("r"), F.count(F.lit(1))).collect()          # a row per pivot
    radius, count = np.zeros(len(p)), np.zeros(len(p))
    for c, r, n in summary:
        radius[c], count[c] = r, n
    # Rows of a query's own key by cell, a struct per cell at most.
    own = (cells.groupBy("id", "cell").agg(F.count(F.lit(1)).alias("n")).join(asked.select("id"), "id", "left_semi")
           .groupBy("id").agg(F.collect_list(F.struct("cell", "n")).alias("own")))
    asked = asked.join(own, "id", "left").select("id", "x", "own")
    routed = asked.mapInArrow(_route(p, radius, count, k), "qid long, cell int, q array<double>").checkpoint()
    waiting = np.zeros(len(p))
    for c, n in routed.groupBy("cell").count().collect():
        waiting[c] = n
    blocks, parts = (F.element_at(F.array(*[F.lit(max(1, int(-(-n // size)))).cast("long") for n in by]), F.col("cell") + 1)
                     for by, size in ((count, BLOCK), (waiting, PORTION)))
    # A block of a cell's rows meets a portion of its queries.
    data = (cells.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))))
    sent = (routed.withColumn("part", F.pmod(F.xxhash64("qid"), parts))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))))
    solved = (sent.groupBy("cell", "block", "part").cogroup(data.groupBy("cell", "block", "part"))
              .applyInArrow(_solve(k, dim), "query_id long, vec_id long, score long"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (solved.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


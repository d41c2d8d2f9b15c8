"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook from a bounded sample. A row's two codes are its
cell; every row is indexed. For an anchor, code i of a half is worth at most `q.c_i + |q| r_i`, with r_i the
largest distance of a row's half from its centre, and a cell at most the sum of its two halves' worths.
A heap over the two sorted lists of worths (a multi-sequence) yields cells from the best sum down, and
an anchor's search ends when the next sum is below all its open windows: below the k-th score found in a
window, or below the window's lower end. So nothing is missed, whatever the codebooks.

Anchors work in rounds. In a round each uncertified anchor visits its next cells, worth a number of
rows that grows from round to round; the rows of a cell meet the anchors that asked for it in blocks.
Positives are one window without ends over rows of the same label; each positive then gives one
window over rows of other labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.topk import pivots, whole

SAMPLE = 4096           # rows that the codebooks are fitted on
CELL_ROWS = 256         # rows of a cell, about: sets the number of codes
CODES = 256             # codes of a half at most; cells beyond that size are solved in blocks
FIRST_ROWS = 2048       # rows that the first round visits for an anchor
GROWTH = 8              # of that number from round to round
BLOCK = 8192            # rows of a cell solved together
PORTION = 8192          # anchors of a cell solved together
ANCHOR_BLOCK = 512      # of a score matrix
SLACK = 1e-9            # of rounding in the bounds, relative


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = max(1, x.shape[1] // 2)
    return x[:, :cut], x[:, cut:]


class Index:
    """Two codebooks, the radius of every code and the number of rows of every cell; bounded by CODES squared."""

    def __init__(self, books):
        self.books, self.radii, self.rows = books, [np.zeros(len(b)) for b in books], np.zeros(len(books[0]) * len(books[1]), np.int64)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(cell, the two codes, the distances of the two halves from their centres)."""
        codes, away = [], []
        for half, book in zip(halves(x), self.books):
            code = ((book ** 2).sum(axis=1)[None, :] - 2 * half @ book.T).argmin(axis=1) if half.shape[1] else np.zeros(len(x), np.int64)
            codes.append(code)
            away.append(np.sqrt(((half - book[code]) ** 2).sum(axis=1)))
        return codes[0] * len(self.books[1]) + codes[1], codes, away

    def worths(self, q: np.ndarray) -> list[np.ndarray]:
        """Upper bound of each half score by code."""
        out = []
        for half, book, radius in zip(halves(q[None]), self.books, self.radii):
            centre, spread = book @ half[0], float(np.linalg.norm(half[0])) * radius
            out.append(centre + spread + SLACK * (1 + np.abs(centre) + spread))
        return out

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of all cells with rows, from the best bound down: a multi-sequence over two sorted lists."""
        worth = self.worths(q)
        order = [np.argsort(-w, kind="stable") for w in worth]
        a, b = (w[o].tolist() for w, o in zip(worth, order))
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):                    # the next row of the grid opens with its best cell
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = int(order[0][i]) * len(b) + int(order[1][j])
            if self.rows[cell]:
                yield -bound, cell


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(index: Index, dim: int, kind: pa.DataType):
    def run(batches):
        for b in batches:
            cell, codes, away = index.assign(_matrix(b.column(2), dim))
            arrays = [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), *(pa.array(c.astype(np.int32)) for c in codes), *map(pa.array, away),
                      b.column(2).cast(pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "cell", "code0", "code1", "away0", "away1", "x"])
    return run


def floors(lo, found, k: int) -> list[float]:
    """Score that a row must reach to matter in each window; found: (window, score, id), the k best of each."""
    scores: dict[int, list[float]] = {}
    for f in found or ():
        scores.setdefault(f["w"], []).append(f["score"])
    return [min(scores[w]) if len(scores.get(w, ())) >= k else a for w, a in enumerate(lo)]


def _plan(sent, k: int, budget: int):
    """For each anchor the cells of its round: those after the `done` ones, up to `budget` rows or its certificate.

    The order of an anchor's cells never changes, so the number of visited ones is all that a round hands on.
    """
    def run(batches):
        index = sent.value
        for b in batches:
            cells, least = [], []
            for q, lo, hi, found, done in zip(*(b.column(c).to_pylist() for c in ("x", "lo", "hi", "found", "done"))):
                least.append(floors(lo, found, k))
                need = min((a for a, b in zip(least[-1], hi) if a <= b), default=float("inf"))
                mine, rows = [], 0
                if need < float("inf"):
                    for seen, (bound, cell) in enumerate(index.cells(np.array(q, float))):
                        if bound < need or rows >= budget:
                            break
                        if seen >= done:
                            mine.append(cell)
                            rows += int(index.rows[cell])
                cells.append(mine)
            arrays = [pa.array(cells, pa.list_(pa.int32())), pa.array(least, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "cells", "least"])
    return run


def _solve(k: int, dim: int, same: bool):
    """The k best rows of a block of a cell in each window of each anchor that asked for the cell."""
    def run(key, asked: pa.Table, data: pa.Table) -> pa.Table:
        q, x = (_matrix(t.column("x").combine_chunks(), dim) for t in (asked, data))
        qid, qlabel, ids, labels = (t.column(c).to_numpy() for t in (asked, data) for c in ("id", "label"))
        if not len(q) or not len(x):
            return _hits([[], [], [], []])
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        lo, hi = (_padded(asked.column(c).combine_chunks()) for c in ("lo", "hi"))
        out = [[], [], [], []]
        for a in range(0, len(q), ANCHOR_BLOCK):
            part = slice(a, a + ANCHOR_BLOCK)
            s = (q[part] @ x.T).round()                                       # whole numbers below 2**53: exact
            alike = qlabel[part, None] == labels[None, :]
            s[(alike if not same else ~alike) | (qid[part, None] == ids[None, :])] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")                      # ties: the smaller id comes first
            for w in range(lo.shape[1]):
                above = (s > hi[part, w, None]).sum(axis=1)
                at = above[:, None] + np.arange(k)[None, :]
                inside = at < s.shape[1]
                col = np.take_along_axis(best, np.minimum(at, s.shape[1] - 1), 1)
                score = np.take_along_axis(s, col, 1)
                keep = inside & (score >= lo[part, w, None]) & np.isfinite(score)
                n = keep.sum(axis=1)
                for held, v in zip(out, (np.repeat(qid[part], n), np.full(n.sum(), w, np.int32), score[keep], ids[col][keep])):
                    held.append(v)
        return _hits(out)
    return run


def _hits(parts) -> pa.Table:
    kinds = (("qid", np.int64), ("w", np.int32), ("score", np.float64), ("id", np.int64))
    return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, t)) for (c, t), v in zip(kinds, parts)})


def _padded(column) -> np.ndarray:
    """Lists of doubles as a matrix; missing places are windows that nothing falls into."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), np.nan)
    for row, v in zip(out, lists):
        row[:len(v)] = v
    return out


def search(state: DataFrame, cells: DataFrame, sent, k: int, dim: int, same: bool) -> DataFrame:
    """`state` with `found`: the k best rows of `cells` in each window, rows of the anchor's label if `same`, else of other labels.

    `done` is the number of cells that an anchor looked into.
    """
    spark = state.sparkSession
    state = state.withColumn("done", F.lit(0)).checkpoint()
    budget = FIRST_ROWS
    while True:
        planned = state.mapInArrow(_plan(sent, k, budget), T.StructType([*state.schema, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("least", T.ArrayType(T.DoubleType()))])).checkpoint()
        # Only rows that reach a window's k-th score so far are worth sending back.
        asked = planned.select("id", "label", "x", F.col("least").alias("lo"), "hi", F.explode("cells").alias("cell"))
        waiting = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}              # a row per cell at most
        if not waiting:
            return state
        sizes = spark.createDataFrame([(c, max(1, -(-int(sent.value.rows[c]) // BLOCK)), max(1, -(-n // PORTION))) for c, n in waiting.items()],
                                      "cell int, blocks int, parts int")
        few = F.broadcast(sizes)                                                             # a row per cell at most
        data = (cells.select("id", "label", "cell", "x").join(few, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
                .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long")))))
        sent_to = (asked.join(few, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
                   .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")))))
        at = ["cell", "block", "part"]
        hits = (sent_to.drop("blocks", "parts").groupBy(*at).cogroup(data.drop("blocks", "parts").groupBy(*at))
                .applyInArrow(_solve(k, dim, same), "qid long, w int, score double, id long"))
        earlier = planned.select(F.col("id").alias("qid"), F.explode("found").alias("f")).select("qid", "f.w", "f.score", "f.id")
        rank = F.row_number().over(W.partitionBy("qid", "w").orderBy(F.desc("score"), "id"))
        best = (hits.union(earlier).withColumn("rank", rank).filter(F.col("rank") <= k)
                .groupBy(F.col("qid").alias("id")).agg(F.collect_list(F.struct("w", "score", F.col("id"))).alias("found")))
        state = (planned.withColumn("done", F.col("done") + F.size("cells")).drop("found", "cells", "least").join(best, "id", "left")
                 .select("id", "label", "x", "lo", "hi", "found", "done").checkpoint())
        budget *= GROWTH


def ranked(state: DataFrame) -> DataFrame:
    """(anchor_id, w, rank, id, score) of the rows that a search found."""
    found = state.select(F.col("id").alias("anchor_id"), F.explode("found").alias("f")).select("anchor_id", "f.w", "f.id", "f.score")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")))


def build(rows: DataFrame, dim: int, n: int) -> Index:
    """An index of `rows` (id, label, x) with the codebooks of a sample; radii and counts are still to be measured."""
    codes = int(np.clip(np.ceil(np.sqrt(n / CELL_ROWS)), 1, CODES))
    picked = rows.orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("x").collect()        # bounded by parameter
    return Index([pivots(h, codes) if h.shape[1] else np.zeros((1, 0)) for h in halves(np.array([r[0] for r in picked], float))])


def mine(rows: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    `anchors` is a condition on `key`. Score: inner product of floor(256 x) components; ties go to the
    smaller key. An anchor's positives are its `positives` best rows of the same label, and for each of
    them the `negatives` best rows of other labels count whose score is from `low` to `high` per cent of the
    positive's. All, if there are fewer; a positive with a score below 0 has no negatives.

    Rows with a null key, label or vector, or a null or non-finite component, take no part, nor do vectors
    without components or of another length than most (the longer, if two are equally frequent). Keys and
    labels are whole numbers. Rows of the anchor's own key are neither positives nor negatives. A repeated
    key is a candidate with each of its rows; as an anchor it stands with the least of its (label,
    vector). Empty tables, and tables without anchors, give no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    clean = (rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole(vector).alias("x"))
             .filter("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0"))
    largest = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    lengths = clean.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n = lengths["d"], lengths["n"]
    clean = clean.filter(F.size("x") == dim)
    index = build(clean, dim, n)
    kind, name = (pa.int16(), "smallint") if lengths["most"] < 1 << 15 else (pa.float64(), "double")
    cells = clean.mapInArrow(_assign(index, dim, kind), "id long, label long, cell int, code0 int, code1 int, away0 double, away1 double, "
                             f"x array<{name}>").checkpoint()
    for c, m in cells.groupBy("cell").count().collect():                                         # a row per cell
        index.rows[c] = m
    for half in (0, 1):
        for c, r in cells.groupBy(f"code{half}").agg(F.max(f"away{half}")).collect():            # a row per code
            index.radii[half][c] = r
    sent = spark.sparkContext.broadcast(index)

    whole_line = {"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))}
    nothing = F.lit(None).cast("array<struct<w:int,score:double,id:long>>")
    asked = (clean.withColumn(key, F.col("id")).filter(anchors).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r"))
             .select("id", "r.label", F.col("r.x").cast(f"array<{name}>").alias("x")).withColumns(whole_line).withColumn("found", nothing))
    state = search(asked, cells, sent, positives, dim, same=True)
    good = ranked(state).select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").cast("long").alias("positive_score")).checkpoint()
    ends = {"lo": f"(positive_score * {low} + 99) div 100", "hi": f"(positive_score * {high}) div 100"}
    windows = good.select(F.col("anchor_id").alias("id"), F.struct(
        "w", *[F.when(F.col("positive_score") >= 0, F.expr(e)).otherwise(1 if c == "lo" else 0).cast("double").alias(c) for c, e in ends.items()]).alias("v"))
    windows = windows.groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("v")).select("id", F.col("v.lo").alias("lo"), F.col("v.hi").alias("hi"))
    state = search(state.select("id", "label", "x").join(windows, "id").withColumn("found", nothing), cells, sent, negatives, dim, same=False)
    bad = ranked(state).select("anchor_id", "w", "rank", F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    return bad.join(good, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

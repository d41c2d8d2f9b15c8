"""Whitening and hard negatives, against plain numpy over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import negatives, whiten
from ebbtide.llm.stage import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, k int, component string"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows from (key, vector, label), with extra columns whose names clash with inner ones."""
    prepare(spark)
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2, "c") for r in rows], SCHEMA)


def floats(rng, n, d, scale=1.0):
    return (rng.standard_normal((n, d)) * scale).astype(np.float32)


def hard_negatives(rows, low=50, high=95, positives=5, negs=3):
    """All pairs in plain Python; keys are unique."""
    use = [(k, [math.floor(256 * float(c)) for c in v], y) for k, v, y in rows
           if k is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for k, v, y in use:
        if k % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, z) for i, w, z in use if i != k)
        for s, i, z in [r for r in scored if r[2] == y][:positives]:
            fits = [(n, j) for n, j, z in scored if z != y and low * -s <= 100 * -n <= high * -s][:negs]
            out |= {(k, i, rank + 1, j, -s, -n) for rank, (n, j) in enumerate(fits)}
    return out


def mined(df, **how):
    return {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **how).collect()}


def test_hard_negatives_equal_all_pairs(vectors, monkeypatch):
    rng = np.random.default_rng(3)
    x = floats(rng, 420, 7)
    x[100:140] = x[50]                                              # a group of equal vectors: ties
    rows = [(int(i), v.tolist(), int(i * 7 % 4)) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 7, 1), (1000, None, 1), (1050, [1.0] * 6 + [None], 1), (1100, [NAN] * 7, 1), (1150, [INF] * 7, 2),
             (1200, [1.0] * 7, None), (1250, [], 1), (1300, [0.0] * 7, 1), (1350, [-3.0] * 7, 9)]
    want = hard_negatives(rows)
    assert mined(vectors(rows)) == want and len(want) > 50
    # Small first rounds, cells and blocks: many rounds, split cells and anchors give the same rows.
    for name, v in (("CELL_ROWS", 4), ("FIRST_ROWS", 10), ("GROWTH", 2), ("BLOCK", 3), ("PORTION", 2), ("ANCHOR_BLOCK", 2)):
        monkeypatch.setattr(negatives, name, v)
    assert mined(vectors(rows)) == want


def test_hard_negatives_odd_tables(vectors):
    assert mined(vectors([])) == set()
    assert mined(vectors([(0, [1.0, 2.0], 1)])) == set()                                     # no positive
    assert mined(vectors([(i, [1.0, 2.0], 1) for i in range(1, 9)])) == set()                # no anchor
    one = [(i, [float(i % 5)], i % 2) for i in range(60)]                                    # vectors of one component
    assert mined(vectors(one)) == hard_negatives(one)
    # A repeated key is a candidate with each row; as an anchor it stands once, and its own rows are no answers.
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (2, [0.75, 0.0], 2), (3, [0.5, 0.0], 2), (4, [0.25, 0.0], 2)]
    assert sorted(tuple(r) for r in negatives.mine(vectors(rows), F.col("vec_id") == 50).collect()) == [
        (50, 1, 1, 2, 65536, 49152), (50, 1, 2, 2, 65536, 49152), (50, 1, 3, 3, 65536, 32768)]


def test_multi_index_visits_few_cells_of_clustered_rows(vectors, spark):
    """The sums fall from cell to cell, bound every score, and certified anchors stop early."""
    rng = np.random.default_rng(5)
    centres = floats(rng, 16, 8, 4.0)
    x = np.floor(256 * (centres[np.arange(4000) % 16] + floats(rng, 4000, 8, 0.05)))
    index = negatives.Index([negatives.pivots(h, 12) for h in negatives.halves(x)])
    cell, codes, away = index.assign(x)
    for half in (0, 1):
        np.maximum.at(index.radii[half], codes[half], away[half])
    np.add.at(index.rows, cell, 1)
    shares = []
    for q in x[::400]:
        order = list(index.cells(q))
        bounds = [b for b, _ in order]
        assert bounds == sorted(bounds, reverse=True) and sorted(c for _, c in order) == np.flatnonzero(index.rows).tolist()
        score = x @ q
        assert all((score[cell == c] <= b).all() for b, c in order)
        fifth = np.sort(score)[-6]
        shares.append(sum(int(index.rows[c]) for b, c in order if b >= fifth) / len(x))
    assert np.mean(shares) < 0.5


def reference(rows, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v, _ in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("n,d", [(300, 50), (400, 40), (90, 5), (40, 36)])
def test_whitening_equals_dense_eigenvectors(vectors, n, d):
    rng = np.random.default_rng(n)
    x = floats(rng, n, d) @ np.diag(np.linspace(1, 2, d)).astype(np.float32)
    x[10:40] = x[9]                                                 # repeated rows count
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] * d, 1), (903, [NAN] * d, 1), (904, [INF] * d, 1), (905, [1.0] * (d + 1), 1)]
    got = whiten.whiten(vectors(rows + bad)).orderBy("vec_id", "component").toPandas()
    k = min(8, d)
    dev, white, share = reference(rows, k)
    assert len(got) == n * k and (got.n == n).all() and got.component.tolist() == list(range(1, k + 1)) * n
    assert got.deviation.tolist()[::k] == dev
    y = got.whitened.to_numpy().reshape(n, k)
    assert np.abs(y * np.sign((y * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got.explained.to_numpy().reshape(n, k) - share).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_tables(vectors):
    assert whiten.whiten(vectors([])).count() == 0
    assert whiten.whiten(vectors([(1, [1.0, 2.0], 1)])).count() == 0                          # no variance
    assert whiten.whiten(vectors([(i, [1.0, 2.0], 1) for i in range(5)])).count() == 0
    # Rank one: one component only; null and repeated keys are returned.
    out = whiten.whiten(vectors([(None, [0.0, 0.0, 0.0], 1), (7, [1.0, 2.0, 0.0], 1), (7, [2.0, 4.0, 0.0], 1)])).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (7, 1), (7, 1)] and abs(out[0].explained - 1) < 1e-12
    # Multiple eigenvalues: some basis of the plane, with a covariance of one.
    square = [(i, [x, y, 0.1 * (i % 3)], 1) for i, (x, y) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)] * 6)]
    out = whiten.whiten(vectors([(i, [float(c) for c in v], y) for i, v, y in square])).collect()
    assert max(r.component for r in out) == 3 and out[0].identity_error < 1e-9


def test_deviations_are_exact_or_null():
    rnd = random.Random(1)
    x = np.array([[rnd.randrange(-10 ** 6, 10 ** 6) for _ in range(9)] for _ in range(20)])
    for n, sums in ((20, [int(v) for v in x.sum(axis=0)]), (10 ** 6, [10 ** 9] * 9), (10 ** 12, [0] * 9)):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
        assert whiten._deviations(x, n, sums).to_pylist() == [v if v < 1 << 63 else None for v in want]

"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, are summed once for the exact mean and packed into blocks. The
covariance is never formed: a pass multiplies it by a thin matrix Q, block by block, as the sum of
(x - mean)(x - mean)^T Q. Each round applies a Chebyshev polynomial of the covariance to Q by its
three-term recurrence, one pass per degree, which damps the spectrum below the block's smallest
Ritz value and lifts what is above; QR and a Rayleigh-Ritz step follow. The product that the step
needs gives the residuals as well, so a component is certified without another pass.

What reaches the driver is a matrix of dimension x block width; a vector never does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 24              # vectors iterated beside the wanted ones; they bound the damped spectrum from above
DEGREE = 8              # of the polynomial, passes a round
LANCZOS = 8             # passes that look for the lower end of the spectrum
ROUNDS = 40
TOLERANCE = 1e-14       # certified: residual norm over the largest eigenvalue
GOOD_ENOUGH = 1e-11     # also certified, if a round no longer improves it: the limit of rounding
NO_VARIANCE = 1e-12     # components below this share of the largest eigenvalue cannot be scaled to variance 1


def whole(vector: str) -> Column:
    """floor(1024 c) + 100000 of every entry; null if the vector is null, empty or holds null or non-finite entries."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return F.when(usable, F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT))


def _pack(dim: int):
    """A block per batch: the vectors as doubles, row by row. Entries are whole numbers, exact below 2**53."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])
    return run


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(dim: int):
    """(entry, its sum, number of vectors) of a task."""
    def run(batches):
        total, n = np.zeros(dim, np.int64), 0
        for b in batches:
            total += _matrix(b.column(0), dim).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, n))], ["i", "s", "n"])
    return run


def _centred(block: bytes, mean: np.ndarray) -> np.ndarray:
    return np.frombuffer(block, np.float64).reshape(-1, len(mean)) - mean


class Covariance:
    """Products of the covariance, divisor n, with thin matrices: one job each."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray, n: int):
        self.blocks, self.mean, self.n, self.passes = blocks, mean, n, 0

    def _summed(self, part, width: int) -> np.ndarray:
        """Sum over the tasks of `part`, a function of a centred block, as a matrix of dimension x width."""
        mean, names = self.mean, [f"y{j}" for j in range(width)]

        def run(batches):
            total = np.zeros((len(mean), width))
            for b in batches:
                for block in b.column(0):
                    total += part(_centred(block.as_py(), mean))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), *map(pa.array, total.T)], ["i", *names])

        sums = self.blocks.mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names]]))
        out = np.zeros((len(mean), width))
        for r in sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():      # dimension x width numbers
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return self._summed(lambda x: x.T @ (x @ q), q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda x: (x ** 2).sum(axis=0)[:, None], 1).sum()) / self.n

    def between(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections on `w`: measured on the projections themselves."""
        k = w.shape[1]

        def part(x):
            y = x @ w
            out = np.zeros((len(w), k))
            out[:k] = y.T @ y
            return out
        return self._summed(part, k)[:k] / self.n


def lower_end(times, dim: int, steps: int = LANCZOS, seed: int = 1) -> float:
    """Where the spectrum begins, as far as a few Lanczos steps see; never below 0."""
    q = np.random.default_rng(seed).standard_normal((dim, 1))
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dim)):
        w = times(basis[-1])
        alpha.append(float((basis[-1].T @ w)[0, 0]))
        full = np.hstack(basis)
        for _ in range(2):
            w = w - full @ (full.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    e, s = np.linalg.eigh(t)
    return max(0.0, float(e[0] - beta[-1] * abs(s[-1, 0])))


def filtered(times, q: np.ndarray, low: float, cut: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of the matrix, small on [low, cut] and 1 at `top`, applied to q."""
    half, centre = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - centre)
    last, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        last, now = now, (times(now) - centre * now) * (2 * after / half) - sigma * after * last
        sigma = after
    return now


def rayleigh_ritz(times, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, falling; vectors; residual norms) of the subspace that y spans, by one pass."""
    q, _ = np.linalg.qr(y)
    w = times(q)
    h = q.T @ w
    e, u = np.linalg.eigh((h + h.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    q = q @ u
    return e, q, np.linalg.norm(w @ u - q * e, axis=0)


def eigen(times, dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(the k largest values, falling; their vectors; the largest residual over the largest value).

    Rounds go on until the residuals are at TOLERANCE, or at GOOD_ENOUGH and no longer fall; a
    spectrum that isn't certified within ROUNDS raises.
    """
    k = min(k, dim)
    width = min(dim, k + GUARD)
    e, q, res = rayleigh_ritz(times, np.random.default_rng(seed).standard_normal((dim, width)))
    if e[0] <= 0:
        return np.zeros(0), np.zeros((dim, 0)), 0.0
    low = lower_end(times, dim) if width < dim else 0.0
    worst = float(res[:k].max() / e[0])
    for _ in range(ROUNDS):
        if worst <= TOLERANCE:
            break
        cut = max(float(e[-1]), 1e-9 * e[0])
        if width < dim and e[0] > cut * (1 + 1e-9):
            q = filtered(times, q, min(low, cut * 0.99), cut, float(e[0]))
        e, q, res = rayleigh_ritz(times, q)
        before, worst = worst, float(res[:k].max() / e[0])
        if worst <= GOOD_ENOUGH and worst > before / 2:
            break
    if worst > GOOD_ENOUGH:
        raise RuntimeError(f"residual {worst:.1e} after {ROUNDS} rounds: components are not certified")
    real = e[:k] > NO_VARIANCE * e[0]
    return e[:k][real], q[:, :k][:, real], worst


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the entries of (n x - sum)**2 for every vector, exact; null where it exceeds a long."""
    if 2 * n * int(np.abs(x).max(initial=0)) < math.isqrt((1 << 63) // max(1, x.shape[1])):
        return pa.array(((n * x - np.array(sums)) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _project(n: int, sums: list[int], mean: np.ndarray, w: np.ndarray):
    """One row per vector and component."""
    k = w.shape[1]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), len(mean))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 _deviations(x, n, sums).take(at), pa.array(((x - mean) @ w).ravel())], ["k", "component", "deviation", "whitened"])
    return run


def whiten(rows: DataFrame, k: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component, k at most.

    Entries c become x = floor(1024 c) + 100000. n: number of vectors; deviation: sum of (n x - sum)**2,
    exact, null if it exceeds a long; whitened: x - mean on the component's unit vector, over the root
    of its eigenvalue; explained: that eigenvalue over the trace; identity_error: largest entry of the
    covariance of `whitened` minus the identity, measured over all vectors.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are vectors of
    another length than most (the longer, if two lengths are equally frequent). Null and repeated keys
    stay: every remaining row counts and is returned. Components without variance cannot be whitened
    and are left out, so equal vectors, a single one or an empty table give no rows. Of a multiple
    eigenvalue some orthonormal basis is returned. Other columns are ignored. Sums of doubles
    depend on the order of tasks in their last digits, and so do the results.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    clean = rows.select(F.col(key).alias("k"), whole(vector).alias("x")).filter("x IS NOT NULL")
    empty = spark.createDataFrame([], f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    most = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return empty.withColumnRenamed("k", key)
    dim = most["d"]
    clean = clean.filter(F.size("x") == dim)
    found = (clean.select("x").mapInArrow(_sums(dim), "i int, s long, n long").groupBy("i")
             .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect())      # a row per entry
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    mean = np.array([s / n for s in sums])
    blocks = clean.select("x").mapInArrow(_pack(dim), "x binary").checkpoint()
    cov = Covariance(blocks, mean, n)
    values, vectors, _ = eigen(cov.times, dim, k)
    if not len(values):
        return empty.withColumnRenamed("k", key)
    w = vectors / np.sqrt(values)
    share = values / cov.trace()
    error = float(np.abs(cov.between(w) - np.eye(len(values))).max())
    out = clean.mapInArrow(_project(n, sums, mean, w), f"k {kind}, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in share]), F.col("component"))
    return out.select(F.col("k").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(error).alias("identity_error"))

"""Special functions as Columns, for tail probabilities of any number of rows."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300             # terms of the continued fraction; it stops changing long before for moderate arguments
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 8, carried back."""
    y = z + 8
    series = sum(F.lit(c) / F.pow(y, F.lit(float(k))) for k, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)))
    back = sum(F.log(z + i) for i in range(8))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * log(2 * pi)) + series - back


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's recurrence."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def turn(state, term):
        d = 1.0 / safe(1.0 + term * state["d"])
        c = safe(1.0 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def step(state, i):
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(turn(state, even), odd)

    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0; 0 and 1 beyond the ends, null for null."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a)
            .when(x.isNotNull(), 1 - front * _fraction(b, a, 1 - x) / b))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs under no association (Student's t with n - 2); null below three pairs."""
    return F.when(n >= 3, incomplete_beta((n - 2) / 2.0, F.lit(0.5), 1 - r * r))

"""Load generation for the benchmark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def amplify(readings: DataFrame, factor: int, jitter: float = 0.15, seed: int = 4177,
            counters: tuple[str, ...] = ("views", "likes", "comments", "value")) -> DataFrame:
    """`factor` copies with their own entities and owners; copy 0 is the table itself.

    Counters are multiplied by a normal factor and kept at or above 0, ages are
    nudged, nulls stay null. Noise is a function of the row and copy, so a lost
    task reproduces it. A load generator: it creates no information.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    if factor == 1:
        return readings
    d = readings.select("*", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_r"))
    key = [F.lit(seed), F.col("_r"), F.col("entity"), F.col("age_hours")]
    u = lambda tag: (F.pmod(F.xxhash64(F.lit(tag), *key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda tag: F.sqrt(-2 * F.ln(u(tag + "r"))) * F.cos(2 * F.pi() * u(tag + "a"))
    cols = {}
    for c in counters:
        if c in readings.columns:
            moved = F.greatest(F.lit(0.0), F.col(c) * (1 + jitter * normal(c)))
            cols[c] = F.when(F.col("_r") == 0, F.col(c).cast("double")).otherwise(
                F.when(F.col(c).isNotNull(), moved))
    cols["age_hours"] = F.when(F.col("_r") == 0, F.col("age_hours")).otherwise(
        F.greatest(F.lit(0.0), F.col("age_hours") * (1 + 0.02 * normal("age"))))
    for c in ("entity", "owner"):
        if c in readings.columns:
            cols[c] = F.when(F.col("_r") == 0, F.col(c)).otherwise(F.concat(F.col(c), F.lit("_r"), F.col("_r")))
    return d.withColumns(cols).drop("_r")


def run_fully(df: DataFrame) -> None:
    """Compute every column of every row. A count would let the optimiser drop the work."""
    df.write.format("noop").mode("overwrite").save()


"""Training helpers shared by the survival models.

A training table has `entity, owner, duration, event` and predictor columns. A
model offers `fit(train, profile)` and, on the fitted object, `predict(df)`,
which adds `predicted` (hours, larger = longer life). Nothing is learned from
test rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import finite
from ebbtide.operators.skew import column_medians

EPSILON = 1e-3
MIN_VALUES = 10


@dataclass(frozen=True)
class Profile:
    """What the models need to know about a training table, from one aggregate row."""

    n: int
    n_events: int
    median_duration: float
    stats: dict[str, tuple]            # column -> (values, median, mean, sd) after median imputation

    @classmethod
    def of(cls, train: DataFrame, columns: list[str]) -> "Profile":
        """Medians are exact at any size: see `exact_quantiles`."""
        cols = [c for c in dict.fromkeys(columns) if c in train.columns]
        aggs = [F.count(F.lit(1)).alias("n"), F.count_if("event").alias("e")]
        for i, c in enumerate(cols):
            x = finite(c)
            aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}"), (F.min(x) < F.max(x)).alias(f"w{i}")]
        r = train.agg(*aggs).first().asDict()
        r["d"] = None
        for name, m in column_medians(train, {"d": F.col("duration").cast("double"), **{f"m{i}": finite(c) for i, c in enumerate(cols)}}).collect():
            r[name] = m                            # a row per column
        stats = {}
        for i, c in enumerate(cols):
            k, m = r[f"c{i}"], r[f"m{i}"]
            if k < MIN_VALUES or not r[f"w{i}"]:
                continue
            share = k / r["n"]                     # the rest becomes the median
            mean = share * r[f"a{i}"] + (1 - share) * m
            var = share * (r[f"v{i}"] + (r[f"a{i}"] - mean) ** 2) + (1 - share) * (m - mean) ** 2
            if var > 0:
                stats[c] = (k, float(m), float(mean), sqrt(var))
        return cls(r["n"], r["e"], float(r["d"]) if r["d"] is not None else 48.0, stats)


@dataclass(frozen=True)
class Design:
    """Median imputation and standardisation of the columns that vary in the training rows."""

    columns: tuple[str, ...]
    stats: dict[str, tuple]

    @classmethod
    def build(cls, profile: Profile, features: list[str], train: DataFrame | None = None) -> "Design | None":
        """With `train`, columns the earlier ones explain almost wholly are dropped too."""
        cols = tuple(c for c in features if c in profile.stats)
        if not cols:
            return None
        design = cls(cols, profile.stats)
        return design._independent(train) if train is not None and len(cols) > 1 else design

    def _independent(self, train: DataFrame, most: float = 0.999) -> "Design":
        c = Correlation.corr(self.transform(train), "features").first()[0].toArray()
        kept: list[int] = []
        for i in range(len(self.columns)):
            if kept:
                r = c[np.ix_(kept, [i])]
                if float((r.T @ np.linalg.pinv(c[np.ix_(kept, kept)]) @ r)[0, 0]) > most:
                    continue
            kept.append(i)
        return Design(tuple(self.columns[i] for i in kept), self.stats)

    def standard(self, c: str, have: bool) -> Column:
        _, median, mean, sd = self.stats[c]
        x = F.coalesce(finite(c), F.lit(median)) if have else F.lit(median)
        return (x - F.lit(mean)) / F.lit(sd)

    def transform(self, df: DataFrame, extra: dict[str, Column] | None = None, out: str = "features") -> DataFrame:
        """Standardised feature vector; `extra` adds named columns to it."""
        cols = {f"_z_{c}": self.standard(c, c in df.columns) for c in self.columns}
        cols.update(extra or {})
        d = VectorAssembler(inputCols=list(cols), outputCol=out).transform(df.withColumns(cols))
        return d.drop(*cols)


@dataclass
class Constant:
    """Predicts one number for everything."""

    value: float

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted", F.lit(float(self.value)))

"""Where queries and their SQL are collected."""

from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 places, whole numbers as bigint, times as text."""
    out = []
    for f in df.schema.fields:
        x, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            x = F.round(x.cast("double"), 6) + F.lit(0.0)      # no negative zero
        elif kind in ("integer", "short", "byte", "long"):
            x = x.cast("bigint")
        elif kind.startswith("decimal"):
            x = x.cast("double")
        elif kind.startswith("timestamp"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        out.append(x.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r(cols: str) -> str:
    """Select list in which `~x` means x rounded to 6 places and `#x` a bigint."""
    out = []
    for c in (x.strip() for x in cols.split(",")):
        if c.startswith("~"):
            out.append(f"round(CAST({c[1:]} AS DOUBLE), 6) + 0.0 AS {c[1:]}")
        elif c.startswith("#"):
            out.append(f"CAST({c[1:]} AS BIGINT) AS {c[1:]}")
        else:
            out.append(c)
    return ", ".join(out)

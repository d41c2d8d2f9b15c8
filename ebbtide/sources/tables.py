"""Typed tables, run logs, dimensions and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CYCLE_SCHEMA = (
    "cycle_id string, started_at string, finished_at string, dry_run boolean, "
    "panel_before struct<posts_total: bigint, posts_active: bigint, posts_due: bigint, "
    "snapshots_total: bigint, snapshots_per_post_mean: double>, "
    "discovered bigint, snapshotted bigint, due_count bigint, "
    "errors array<string>, files array<string>, "
    "quota struct<units_spent: bigint, calls: bigint, budget: bigint, by_endpoint: map<string, bigint>>, "
    "quota_exceeded boolean")


def as_panel(df: DataFrame, **names: str) -> DataFrame:
    """Rename a user's columns to the contract, e.g. `as_panel(df, entity="post_id")`."""
    return df.withColumnsRenamed({have: want for want, have in names.items()})


def assert_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Fail early where a layer's contract is broken; returns `df` unchanged."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {n: (t, have.get(n)) for n, t in expected.items() if have.get(n) != t}
    if wrong:
        raise ValueError(f"schema contract broken (column: expected, found): {wrong}")
    return df


def write_silver(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_cycle_logs(spark: SparkSession, root: str, per_line: bool = False) -> DataFrame:
    """One row per collection run; a file holds one run, or one per line. Unreadable ones are skipped."""
    text = spark.read.text(root, wholetext=not per_line)
    good = text.filter(F.try_parse_json("value").isNotNull())
    return good.select(F.from_json("value", CYCLE_SCHEMA).alias("r")).select("r.*")


def read_frame(spark: SparkSession, path: str, fmt: str = "json",
               schema: str | None = None) -> DataFrame:
    """The sampling-frame dimension, one row per owner."""
    r = spark.read.format(fmt)
    if schema:
        r = r.schema(schema)
    return (r.option("header", True) if fmt == "csv" else r).load(path)


def strict(kind: T.DataType, x: Column) -> Column:
    """NaN and infinities become null at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: strict(kind.elementType, e))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: strict(kind.valueType, v))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[
            strict(f.dataType, x.getField(f.name)).alias(f.name) for f in kind.fields]))
    return x


def strict_json(df: DataFrame) -> DataFrame:
    return df.select(*[strict(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def export_strict_json(df: DataFrame, path: str) -> None:
    """JSON in which no number is NaN or infinite."""
    strict_json(df).write.mode("overwrite").json(path)


def _without(kind: T.DataType, x: Column, names: frozenset[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        if not kept:
            return F.lit(None).cast("string")
        return F.when(x.isNotNull(), F.struct(*[
            _without(f.dataType, x.getField(f.name), names).alias(f.name) for f in kept]))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _without(kind.elementType, e, names))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        clean = F.map_filter(x, lambda k, _: ~k.isin(*sorted(names)))
        return F.transform_values(clean, lambda _, v: _without(kind.valueType, v, names))
    return x


# Field names that identify an account or an item.
IDENTIFIERS = frozenset({"post_id", "creator_id", "video_id", "channel_id", "handle", "title"})


def strip_identifiers(df: DataFrame, names: frozenset[str] = IDENTIFIERS) -> DataFrame:
    """Drop the named fields at every nesting depth."""
    return df.select(*[_without(f.dataType, F.col(f"`{f.name}`"), names).alias(f.name)
                       for f in df.schema.fields if f.name not in names])


def write_predictions(by_model: dict[str, DataFrame], path: str) -> None:
    """Long out-of-fold table, one row per model and entity."""
    stack_models(by_model).write.mode("overwrite").partitionBy("model").parquet(path)


def stack_models(by_model: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in by_model.items():
        d = df.withColumn("model", F.lit(name))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no models to stack")
    return out

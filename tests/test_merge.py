"""Partition merges that are interrupted lose and double nothing."""

import pytest
from pyspark.sql import functions as F

from ebbtide.sources import bronze
from ebbtide.streaming import streams as T

REC = "post_id string, v long, _ingested_at string, dt string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), REC)


def state(spark, path):
    return sorted((r.post_id, r.v, r.dt) for r in spark.read.schema(REC).parquet(str(path)).collect())


class Lost(Exception):
    pass


def breaks(monkeypatch, name, when):
    """Make one step fail, before or after it has done its work."""
    real = getattr(bronze, name)

    def step(*a, **k):
        if when == "after":
            real(*a, **k)
        monkeypatch.setattr(bronze, name, real)
        raise Lost
    monkeypatch.setattr(bronze, name, step)


@pytest.mark.parametrize("step,when", [("_mark", "before"), ("_mark", "after"), ("_publish", "before"), ("_publish", "after"), ("_done", "before"),
                                       ("_done", "after"), ("remove", "before")])
@pytest.mark.parametrize("keys", [("post_id",), None])
def test_a_merge_broken_anywhere_is_finished_by_the_next(spark, tmp_path, monkeypatch, step, when, keys):
    target, staging = str(tmp_path / "t"), str(tmp_path / "s")
    merge = lambda df, i: bronze.merge_partitions(df, target, staging, keys, ("dt",), batch=i)
    merge(rows(spark, ("a", 1, "1", "x"), ("b", 1, "1", "y")), 0)
    second = rows(spark, ("c", 2, "2", "x"), ("d", 2, "2", "z"))
    breaks(monkeypatch, step, when)
    with pytest.raises(Lost):
        merge(second, 1)
    merge(second, 1)                                               # the batch is run again
    merge(rows(spark, ("e", 3, "3", "y")), 2)
    merge(rows(spark, ("e", 3, "3", "y")), 2)                      # a replay
    assert state(spark, target) == [("a", 1, "x"), ("b", 1, "y"), ("c", 2, "x"), ("d", 2, "z"), ("e", 3, "y")]
    assert [n for n in bronze._names(spark, staging)] == ["done-2"]


def test_a_half_published_stage_is_published_again(spark, tmp_path, monkeypatch):
    """The crash comes when some partitions are replaced and others are not."""
    target, staging = str(tmp_path / "t"), str(tmp_path / "s")
    merge = lambda df: bronze.merge_partitions(df, target, staging, ("post_id",), ("dt",))
    merge(rows(spark, ("a", 1, "1", "x"), ("b", 1, "1", "y")))
    real = bronze._publish

    def half(spark, stage, target, schema, fmt, parts):
        (spark.read.schema(schema).parquet(f"{stage}/rows").filter("dt = 'x'").write.option("partitionOverwriteMode", "dynamic")
         .mode("overwrite").partitionBy(*parts).parquet(target))
        monkeypatch.setattr(bronze, "_publish", real)
        raise Lost
    monkeypatch.setattr(bronze, "_publish", half)
    with pytest.raises(Lost):
        merge(rows(spark, ("a", 5, "2", "x"), ("b", 5, "2", "y")))
    assert state(spark, target) == [("a", 5, "x"), ("b", 1, "y")]
    merge(rows(spark, ("c", 7, "3", "z")))                         # another batch finishes it first
    assert state(spark, target) == [("a", 5, "x"), ("b", 5, "y"), ("c", 7, "z")]
    assert bronze._names(spark, staging) == []


def test_only_touched_partitions_are_read(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    rows(spark, *[(str(i), i, "1", f"d{i % 5}") for i in range(50)]).write.partitionBy("dt").parquet(target)
    table = spark.read.schema(REC).parquet(target)
    batch = rows(spark, ("1", 9, "2", "d1"), ("x", 9, "2", "d3"), ("y", 9, "2", None))
    part = bronze._touched(table, batch, ("dt",))
    assert part.count() == 20 and len(part.inputFiles()) >= 2
    assert {f.split("dt=")[1][:2] for f in part.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"d1", "d3"}
    assert "PartitionFilters: [" in part._jdf.queryExecution().toString() and "PartitionFilters: []" not in part._jdf.queryExecution().toString()
    monkeypatch.setattr(bronze, "MAX_LISTED", 1)                   # too many to name: a join, the same rows
    assert sorted(bronze._touched(table, batch, ("dt",)).collect()) == sorted(part.collect())


def test_rows_without_a_partition_value_stay(spark, tmp_path):
    merge = lambda df: bronze.merge_partitions(df, str(tmp_path / "t"), str(tmp_path / "s"), ("post_id",), ("dt",))
    merge(rows(spark, ("a", 1, "1", None)))
    merge(rows(spark, ("b", 2, "1", None)))
    assert spark.read.schema(REC).parquet(str(tmp_path / "t")).count() == 2


def test_a_stream_without_keys_appends_each_batch_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    for i in range(3):
        rows(spark, (f"p{i}", i, "1", "x")).coalesce(1).write.mode("append").parquet(path)
    run = lambda: T.stream_merge(T.stream_table(spark, path, 1), str(tmp_path / "t"), str(tmp_path / "m"), None, ("dt",))
    breaks(monkeypatch, "remove", "before")
    with pytest.raises(Exception, match="Lost"):
        run()
    assert run().count() == 3 and run().count() == 3

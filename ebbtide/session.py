"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "ebbtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    `master` is left to the submitting environment unless given. Shuffle
    partitions are left to the cluster's setting; adaptive execution merges
    small ones and splits skewed joins.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",   # no stack capture per expression
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def size_shuffles(spark: SparkSession, *inputs, target: int = 128 << 20, cores: int | None = None) -> int:
    """Set the number of shuffle partitions from the bytes the inputs read.

    Adaptive execution merges partitions that turn out small but cannot add any,
    so a large job must start with enough for each to fit a task.
    """
    from ebbtide.operators.skew import plan_bytes
    total = sum(plan_bytes(df) or 0 for df in inputs)
    n = max(cores or spark.sparkContext.defaultParallelism, -(-total // target))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and staged tables.

    On a cluster this is what `spark.checkpoint.dir` names. Only a session
    without that setting (a local test) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="ebbtide-ckpt-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df):
    """Materialise `df` in the shared folder so lost executors cost no long recompute."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(checkpoint_dir(spark), "lineage"))
    return df.checkpoint(eager=True)

"""Session settings that these operators need, and the shared folder for cut lineage."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ebbtide.session import checkpoint_dir

BATCH_ROWS = "1000"     # rows of an Arrow batch: whole texts, so fewer than Spark's default


def prepare(spark: SparkSession) -> SparkSession:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(checkpoint_dir(spark), "lineage"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark

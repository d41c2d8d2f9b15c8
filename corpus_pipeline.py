"""A training corpus from `documents`: toxic texts and near copies out, benchmark leaks out, sources mixed, shards dealt.

Each stage reads what its predecessor kept. All but the last return the columns of documents; the
last adds each row's shard.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, minhash, mixing, sharding, toxicity
from ebbtide.llm.stage import prepare
from ebbtide.session import checkpoint_dir
from ebbtide.sources.bronze import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than one half; labels of four documents in five teach the scores."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(toxicity.remainder("doc_id") != 0)
    return toxicity.reject(docs, labels.select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked by a similarity of 0.8 or more."""
    prepare(spark)
    return minhash.keep_one(docs, words=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard: `shard` (depth:prefix:page) and its bytes."""
    prepare(spark)
    out = sharding.shard(docs)
    return out.select(*docs.columns, F.concat_ws(":", "__depth", "__prefix", "__page").alias("shard"), F.col("__shard_bytes").alias("shard_bytes"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks),
          ("mixing", mix_sources), ("sharding", deal_shards)]
ORACLE_SQL = None       # scores, signatures and templates have no SQL; tests plant cases for every stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again.

    A stage's folder goes when its successor is written; that of the last stage holds the result and stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs

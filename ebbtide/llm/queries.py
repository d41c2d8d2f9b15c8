"""One query per operator, over whole tables, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import chat, decontaminate, lm, minhash, mixing, negatives, pii, quality, secrets, sharding, topk, toxicity, whiten
from ebbtide.llm.registry import ORACLES, QUERIES, query, table
from ebbtide.llm.stage import prepare

__all__ = ["ORACLES", "QUERIES"]


@query("op1_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), sf_dir, "documents"), words=4)


@query("op2_mix_sources", mixing.oracle())
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


@query("op3_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    labels = table(spark, sf_dir, "labels").filter(toxicity.remainder("doc_id") != 0)
    out = toxicity.score(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))
    return out.select("doc_id", (toxicity.remainder("doc_id") == 0).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= 0.5).cast("int").alias("predicted"))


@query("op4_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(prepare(spark), sf_dir, "documents")))


@query("op5_extendible_shards", sharding.oracle())
def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", F.col("__bytes").alias("bytes"), F.col("__depth").alias("depth"), F.col("__prefix").alias("prefix"),
                      F.col("__page").alias("page"), F.col("__shard_bytes").alias("shard_bytes"))


@query("op6_secrets")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of four documents in five teach the forest. The secrets themselves are not shown."""
    out = secrets.scan(table(prepare(spark), sf_dir, "documents"), train_on=F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0)
    return out.select("doc_id", "start", "end", "score", "secret")


@query("op7_decontaminate")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", F.col("of").alias("item_windows"), "slots", F.col("agree").alias("slots_agreeing"))


@query("op8_pseudo_likelihood")
def pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", F.col("__tokens").alias("n_tokens"), F.col("__log_likelihood").alias("log_likelihood"),
                      F.col("__per_token").alias("per_token"))


@query("op9_chat_format")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of four conversations in five teach the model."""
    rows = table(prepare(spark), sf_dir, "conversations")
    return chat.format_chats(rows, train_on=F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)


TOP_K_SQL = """
    WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op10_voronoi_top_k", TOP_K_SQL)
def voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(prepare(spark), sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


HARD_NEGATIVES_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS x
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score
          FROM v a JOIN v ON a.vec_id <> v.vec_id AND a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh key are moved on by one, as the contract has it."""
    rows = table(prepare(spark), sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows that are not held out teach the trees."""
    spark = prepare(spark)
    labels = table(spark, sf_dir, "labels").filter(toxicity.remainder("doc_id") != 0)
    out = quality.score(table(spark, sf_dir, "documents"), labels.select("doc_id", "quality"))
    return out.select("doc_id", (toxicity.remainder("doc_id") == 0).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= 0.3).cast("int").alias("predicted"))


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(prepare(spark), sf_dir, "embeddings"))

"""A training-data pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import line_dedup, ngram_join, packing, pii, quality_rules
from quire.storage import staged


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text that a stage changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_rules(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents left without a word go."""
    return _counted(line_dedup.dedup_lines(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id; rows alike once.

    Only ids and hashes go through the join; the texts are shuffled once, to
    lose those that go.  A document without an id goes if its group has an id.
    Of a group's rows that share the least id, or have none, but differ in
    their texts, the one of least hash stays.
    """
    marked = docs.withColumn("q_hash", F.xxhash64("text"))
    named = staged(ngram_join.classes(marked, keep=("q_hash",), root="q_root"), "classes")
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    others = named.where(~head)
    several = named.where(head & F.col("q_root").isNotNull()).groupBy("q_root").agg(F.min("q_hash").alias("q_stays"), F.max("q_hash").alias("q_last")).where("q_stays <> q_last")
    others = others.select("doc_id", "q_hash").unionByName(named.where(head).join(several, "q_root").where("q_hash <> q_stays").select("doc_id", "q_hash"))
    gone = others.select(F.col("doc_id").alias("g_id"), F.col("q_hash").alias("g_hash")).distinct()
    kept = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("q_hash") == F.col("g_hash")), "left_anti")
    repeated = named.groupBy("doc_id", "q_hash").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "q_hash"])
    return kept.select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked by kind."""
    return _counted(pii.mask(docs, pii.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: No stage but the masking can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` table on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

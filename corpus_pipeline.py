"""A training-corpus pipeline: STAGES in order, each over all documents that the stage before it kept.

quality_classifier drops documents that the co-trained classifier rejects; minhash_dedup keeps one document of each group of
near duplicates (five-word shingles, similarity of 0.8 or more); suffix_dedup takes out strings of LEAST_REPEAT bytes that
occur more than once; decontamination drops documents that hold a benchmark item; sentencepiece encodes what is left.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import cotraining, decontamination, merge_dropout, suffix_dedup, superminhash
from corpusmill.llm.scratch import Scratch

#: About the length of 50 short words in bytes.
LEAST_REPEAT = 200


#: Bytes of an Arrow batch between an executor and its Python workers, each of which holds two of them at least.
BATCH_BYTES = 16 << 20


def _small_batches(spark: SparkSession) -> None:
    """Long texts make batches of 10,000 rows large; this bounds them by bytes for the session. Results do not hang on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return cotraining.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return superminhash.keep_one(docs, shingle=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    cut = suffix_dedup.without_repeats(docs, length=LEAST_REPEAT)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return merge_dropout.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the tokenizer have no SQL form; tests/llm hold each stage, and co-training's rounds, against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs

"""Corpus pipeline: five cleaning stages over ``documents``, each one text operator.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps, with the columns of ``documents``; the last returns token ids.

1. toxicity: documents scored 0.5 or more go.
2. simhash: one document of each near-duplicate group stays, the one of the least id
   (shingles of three words, at most two bits).
3. decontaminate: rows whose text holds a benchmark item go; others under the same id, or without one, stay.
4. pii: personal data is replaced by its kind in brackets; ``n_chars`` follows the text.
5. bpe: token ids of each text, with the digests of the ids and of the decoded text.

Each stage works on all that its predecessor kept.  Null and empty texts pass every
stage (they are near duplicates of each other, so one of them stays); an empty table
stays empty.  Extra columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import bpe, decontaminate, pii, simhash, toxicity
from tillsight.llm.queries import read, tokenizer_file
from tillsight.session import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(spark, docs, read(spark, sf_dir, "labels"))
    scored = docs.withColumn("__toxicity_score", toxicity.score_column(spark, F.col("text"), model))
    return scored.where("__toxicity_score < 0.5").drop("__toxicity_score")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs, shingle=3, max_distance=2)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", pii.redacted_column(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return clean


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers go on to the next run's stages, so the encoder keeps fewer words here and goes with its task
    coded = bpe.encode_documents(docs, tokenizer_file(), cache_words=120_000, reuse=False)
    return coded.select("doc_id", "ids", *bpe.digest_columns())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", encode_stage),
]

#: Fingerprints, groups and token ids can't be written as one SQL statement; tests hold the
#: result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

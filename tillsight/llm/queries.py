"""Registered queries of the text operators: each applies its operator, with production
parameters, to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import bpe, debruijn, decontaminate, html_text, neighbours, pii, radix, secrets, simhash, spelling, suffixes, toxicity, whitening

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_file()))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(read(spark, sf_dir, "documents")))


@query
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(read(spark, sf_dir, "documents")))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(read(spark, sf_dir, "documents")))


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(read(spark, sf_dir, "documents")))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(debruijn.repeated_spans(read(spark, sf_dir, "documents")))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.copies(read(spark, sf_dir, "documents"))


LLM_ORACLES["op11_radix"] = """
    SELECT doc_id, max(doc_id) OVER equal_texts AS keep_id, count(*) OVER equal_texts AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW equal_texts AS (PARTITION BY coalesce(text, ''))
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), delete_every=97)

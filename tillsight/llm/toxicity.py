"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text, each present or not: its lower-cased words, pairs of neighbouring
words and pairs with one word between them, hashed into ``2 ** BITS`` coordinates.
Training is FTRL-proximal: every coordinate has its own learning rate, from the
gradients it has seen, and L1 keeps at zero what does not earn its place, so the model
is a short list of (coordinate, weight).  It is broadcast: at most ``2 ** BITS`` entries
whatever the data, a few thousand in practice.

Learning takes a bounded sample (``SAMPLE_PER_CLASS`` rows of each label, chosen by a hash
of the id) of the labelled rows that are not held out.  Their features are made where
the documents are read; one small task fits the weights on them.  Scoring is a map over
all documents, whole texts.

Defined cases: null and empty texts have no features and get the score of the bias
alone.  Null labels and ids are not learnt from; if an id is labelled twice, it is toxic
if any label says so, and rows that repeat an id and text teach once.  If one of the two
labels has no training row the model is empty and every score is 0, so nothing is
rejected.  Repeated rows repeat their score; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillsight.llm.batches import bounded_batches

BITS = 22
SAMPLE_PER_CLASS = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 7.0, 0.1
#: Words whose hash one Python worker keeps; past it the cache starts anew.
CACHE_WORDS = 100_000
#: Odd multipliers that tell the three kinds of feature apart.
PAIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SKIP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Features:
    """Text -> sorted distinct coordinates."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known, self.words = np.uint64(64 - bits), WordHashes(), re.compile(r"\w+").findall

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words((text or "").lower())
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        mixed = [h]
        for step, (a, b) in ((1, PAIR), (2, SKIP)):
            x = h[:-step] * np.uint64(a) ^ (h[step:] * np.uint64(b)) >> np.uint64(3)
            mixed.append(x * np.uint64(PAIR[0]))
        return np.unique(np.concatenate(mixed) >> self.shift).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over ``rows`` in their order, ``EPOCHS`` times: bias, coordinates, weights.
    The rarer label's gradients weigh more, so that both labels weigh the same in sum."""
    n, positive = 1 << bits, sum(label for _, label in rows)
    gain = (len(rows) / 2 / max(1, len(rows) - positive), len(rows) / 2 / max(1, positive))
    z, g2 = np.zeros(n + 1, np.float64), np.zeros(n + 1, np.float64)  # the last coordinate is the bias

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for x, label in rows:
            i = np.append(x, n)
            w = weights(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
            g = (p - label) * gain[label]
            old = g2[i]
            g2[i] = new = old + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
    kept = np.flatnonzero(np.abs(z[:n]) > L1)
    return float(weights(np.array([n]))[0]), kept.astype(np.int32), weights(kept)


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, features) of the sample.  Only the sampled ids, at most twice
    ``SAMPLE_PER_CLASS``, are broadcast to where the documents are read."""
    bounded_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull())
        .groupBy("__id").agg(F.max("__label").alias("__label"))
        .where(~held_out(F.col("__id")))
    )
    # ids first: a label whose document is not in the input can't be learnt from
    there = docs.select(F.col(id_col).cast("long").alias("__id")).distinct()
    known = known.join(there, "__id", "left_semi")
    order = [F.xxhash64("__id"), F.col("__id")]
    halves = [known.where((F.col("__label") > 0) == side).orderBy(*order).limit(SAMPLE_PER_CLASS) for side in (True, False)]
    sample = halves[0].unionByName(halves[1])

    @arrow_udf("array<int>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Features()
        for texts in batches:
            yield pa.array([of(t.as_py()) for t in texts], pa.list_(pa.int32()))

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # the order of training comes from another hash than the choice of the sample: that one has the
    # labels in different ranges, and a run of one label at the end would shift the bias
    rows = texts.join(F.broadcast(sample), "__id").dropDuplicates(["__id", "__text"])
    return rows.select((F.col("__label") > 0).cast("int").alias("label"), F.xxhash64("__id", F.lit("turn")).alias("turn"),
                       F.col("__id").alias("id"), features("__text").alias("features"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Model (bias, coordinates, weights); coordinates are empty where a label has no row."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        rows = list(zip(pdf["features"], pdf["label"]))
        if pdf["label"].nunique() < 2:
            return pd.DataFrame({"coordinate": pd.Series([], dtype="int32"), "weight": pd.Series([], dtype="float64")})
        bias, at, w = fit(rows)
        return pd.DataFrame({"coordinate": np.append(at, -1).astype("int32"), "weight": np.append(w, bias)})

    rows = training_rows(docs, labels, id_col, text_col)
    # one group by design: the sample is bounded whatever the table's size
    model = rows.groupBy(F.lit(0).alias("__all")).applyInPandas(learn, "coordinate int, weight double").toPandas()
    if model.empty:
        return None
    bias = float(model.loc[model["coordinate"] < 0, "weight"].iloc[0])
    model = model[model["coordinate"] >= 0]
    return bias, model["coordinate"].to_numpy(np.int32), model["weight"].to_numpy(np.float64)


def score_column(spark: SparkSession, text: Column, model) -> Column:
    """Probability of the label 1, 0 to 1."""
    if model is None:
        return F.lit(0.0)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, at, weight = sent.value
        dense, of = np.zeros(1 << BITS, np.float32), Features()
        dense[at] = weight
        for texts in batches:
            sums = np.array([dense[of(t.as_py())].sum(dtype=np.float64) for t in texts], np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))), pa.float64())

    return score(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    spark = docs.sparkSession
    model = train(spark, docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), score_column(spark, F.col(text_col), model).alias("score"))
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""SimHash near-duplicates with multi-index hashing.

A fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of a
text's word shingles, repeats included.  Two fingerprints link if at most
``max_distance`` bits differ; documents of linked fingerprints form groups.

Search over distinct fingerprints, so any number of copies is one entry.  Each is
cut in two segments of 32 bits.  If at most two bits differ, either the first segments
differ in at most one bit, or the second ones are equal.  So the table is keyed by
segment value, and each fingerprint is looked up under the values in a small
Hamming ball around its own segments: radius one around the first, zero around the
second (one too for a distance of three).  Keys also hold a piece of the other segment:
with ``r`` bits left to differ there, one of ``r + 1`` pieces must be equal.
That keeps the lists under a key short when many documents are alike.
Every match is verified by its whole distance.

Defined cases: null and empty texts have fingerprint zero, which links like any other.
A text of fewer words than the shingle length is one shingle.  Null ids belong to groups
but never name one, unless the group has no other.  Rows that repeat an id get the group of their own
fingerprint.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillsight.llm.batches import bounded_batches
from tillsight.llm.graph import components
from tillsight.session import checkpoint_dir

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = min(shingle, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*[words[i:] for i in range(n)])
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, len(words) - n + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    bounded_batches()
    return of(text)


def _pieces(segment: Column, n: int) -> list[Column]:
    """A segment of 32 bits in ``n`` pieces of about the same width."""
    edges = [round(32 * i / n) for i in range(n + 1)]
    return [F.shiftright(segment, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]


def _cleared(segment: Column) -> Column:
    """The values one bit below ``segment``: each of its set bits cleared."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit(segment, b) == 1)
    return F.transform(bits, lambda b: segment.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def _key(tag: int, piece: Column):
    return lambda at: F.struct(F.lit(tag).alias("tag"), at.alias("at"), piece.alias("piece"))


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``prints`` (fp, distinct) -> (u, v) with u < v for each pair at 1 to ``max_distance`` bits."""
    if not 1 <= max_distance <= 3:
        raise ValueError("max_distance: 1 to 3, one bit at most is enumerated in a segment")
    halves = prints.select(
        "fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    keys = lambda tag, segment, other, left: [_key(tag * 8 + j, p)(segment) for j, p in enumerate(_pieces(other, left + 1))]
    table, ball = [], []
    for seg, radius in (("hi", max_distance // 2), ("lo", (max_distance - 1) // 2)):
        own, other = F.col(seg), F.col("lo" if seg == "hi" else "hi")
        tag = 1 if seg == "hi" else 3
        table += keys(tag, own, other, max_distance)
        if radius:
            # of two values one bit apart, the one that has the bit finds the other by clearing it
            table += keys(tag + 1, own, other, max_distance - 1)
            for k, piece in enumerate(_pieces(other, max_distance)):
                ball.append(F.transform(_cleared(own), _key((tag + 1) * 8 + k, piece)))
    table_rows = halves.select("fp", F.explode(F.array(*table)).alias("k")).select("fp", "k.*")
    same = table_rows.where(F.floor(F.col("tag") / 8) % 2 == 1).withColumn("probe", F.lit(False))
    probes = same
    if ball:
        near = halves.select("fp", F.explode(F.concat(*ball)).alias("k")).select("fp", "k.*").withColumn("probe", F.lit(True))
        probes = same.unionByName(near)
    x, y = probes.alias("x"), table_rows.alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_distance
    found = x.join(y, (F.col("x.tag") == F.col("y.tag")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.piece") == F.col("y.piece"))
                   & (F.col("x.fp") != F.col("y.fp")) & (F.col("x.probe") | (F.col("x.fp") < F.col("y.fp"))) & close)
    return found.select(F.least("x.fp", "y.fp").alias("u"), F.greatest("x.fp", "y.fp").alias("v")).distinct()


def groups(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``prints`` (fp, distinct) -> (fp, root): the least fingerprint of its group."""
    joined = components(links(prints, max_distance))
    return prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (long) and ``component_id``, the least id of its group."""
    checkpoint_dir(docs.sparkSession)
    marked = docs.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle).alias("fingerprint")).checkpoint()
    prints = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("first")).checkpoint()
    rooted = groups(prints.select("fp"), max_distance)
    named = rooted.join(prints, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_print, marked["fingerprint"] == of_print["fp"]).select(id_col, "fingerprint", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
              max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the one of the least id (then fingerprint, then
    hash of the text); null ids come last, and of rows alike in id and text one stays.
    The columns stay as they are."""
    checkpoint_dir(docs.sparkSession)
    key = ["no_id", "id", "fp", "text"]  # none is null, so the join keeps the rows where dropDuplicates needs them
    marked = docs.select(  # the rows' own columns are carried as one, so their names can't clash
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"), F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(id_col).alias("order"),
        fingerprint_column(F.col(text_col), shingle).alias("fp"), F.xxhash64(text_col).alias("text"))
    best = marked.groupBy(F.col("fp").alias("print")).agg(F.min(F.struct("no_id", "order", "id", "fp", "text")).alias("best"))
    best = best.select(F.col("print").alias("fp"), "best").checkpoint()
    rooted = groups(best.select("fp"), max_distance)
    kept = rooted.join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.*").select(*[F.col(k).alias(f"kept_{k}") for k in key])
    one = [marked[k] == kept[f"kept_{k}"] for k in key]
    return marked.join(kept, one[0] & one[1] & one[2] & one[3], "left_semi").dropDuplicates(key).select("carried.*")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

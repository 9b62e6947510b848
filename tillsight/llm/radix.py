"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by the first digit of their text (``FIRST`` bytes), then the groups that still hold
several unfinished texts by the next digit, and so on; a digit is a run of successive bytes and
each is ``GROWTH`` times as long as the one before, so texts of 8 MB take four rounds and not 8
million.  A group is done when it has one row, or when its texts have ended (a digit shorter than its round's
width).  Texts are equal when all their bytes have been: no digest takes part.

A round is an aggregate of (group, digit), partial on the map side, so a group of copies ships one row a
task, and a join of the rows with the groups of several.  Rows that stand alone match nothing and are
done; a hot group is the skewed side of that join, which Spark splits.  What the round leaves is written
to the shared folder once: done rows without text, the others with the text that is left.
The driver sees one flag a round.

Defined cases: null counts as the empty text; all empty texts are one group.  The row of the largest id
stays; null ids come last, and of rows alike in text and id one stays.  Texts of any length are
compared whole.  An empty table gives an empty result.  Columns of any name are carried along as they are.
``docs`` is read twice, so its rows must be the same at both times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.session import stored

FIRST, GROWTH = 256, 32


def _split(rows: DataFrame, group: list[str], width: int, name: str) -> DataFrame:
    """One round over ``rows`` (carried, id, rest and the columns of ``group``): group_size and keep of each row's new
    group, whether it is ``open`` still, its new ``grp``, and of open rows the ``rest`` of the text."""
    cut = rows.withColumn("digit", F.substring("rest", 1, width))
    key = [*group, "digit"]
    several = cut.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("id").alias("keep")).where("group_size > 1")
    several = stored(several.withColumn("new", F.monotonically_increasing_id()), f"radix-groups-{name}")  # numbered once
    met = cut.join(several, key, "left")
    is_open = F.col("new").isNotNull() & (F.length("digit") == width)
    return met.select(
        "carried", "id", F.col("new").alias("grp"), F.monotonically_increasing_id().alias("row"), is_open.alias("open"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("new").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.when(is_open, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"))


def grouped(docs: DataFrame, carried: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(carried, id, keep, group_size, kept) for each row of ``docs``; ``carried`` is any expression over it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(carried.alias("carried"), F.col(f"`{id_col}`").alias("id"), text.alias("rest"))
    width, group, done = FIRST, [], []
    while True:
        state = stored(_split(rows, group, width, f"{width}"), f"radix-rows-{width}")
        done.append(state.where("not open").select("carried", "id", "keep", "group_size", "row", "grp", F.lit(len(done)).alias("round")))
        rows = state.where("open").select("carried", "id", "rest", "grp")
        if rows.isEmpty():
            break
        width, group = width * GROWTH, ["grp"]
    ended = reduce(DataFrame.unionAll, done)
    out = ["carried", "id", "keep", "group_size"]
    keeper = (F.col("group_size") > 1) & F.col("id").eqNullSafe(F.col("keep"))
    others = ended.where(~keeper).select(*out, (F.col("group_size") == 1).alias("kept"))
    # one row a group, but for rows alike in text and id: the last of them stays
    keepers = ended.where(keeper)
    last = keepers.groupBy(F.col("round").alias("r"), F.col("grp").alias("g")).agg(F.max("row").alias("last"))
    marked = keepers.join(last, (keepers["round"] == last["r"]) & (keepers["grp"] == last["g"])).select(*out, (F.col("row") == F.col("last")).alias("kept"))
    return others.unionAll(marked)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row; the digest is output only."""
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256)
    found = grouped(docs, sha, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("carried").alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return grouped(docs, whole, id_col, text_col).where("kept").select("carried.*")

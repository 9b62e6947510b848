"""Period-over-period compare of top lists.

The reference compares one upload with the one before it, in one process.  Here
uploads are rows of one table keyed by ``(group…, upload)`` and a ``pairs``
table says which upload is compared with which, so every store's compare runs
in the same job.  All joins are equi-joins on ``(group…, item_name)``; the top
lists come from ``WindowGroupLimit`` top-k, so only N rows per upload travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import by_measure_then_name, pct_change, whole_units
from .ranking import rank_all, top_k

# Panel status texts (the count is the panel size).
STILL_TEXT = "Still Top {n}"
DROPPED_TEXT = "Dropped from Top {n}"


def upload_items(sales: DataFrame, group_cols: Sequence[str], upload_col: str) -> DataFrame:
    """All items of every upload with whole-unit quantity (A3 per upload)."""
    s = sales.groupBy(*group_cols, upload_col, "item_name").agg(F.sum("quantity").alias("qty_sum"))
    return s.withColumn("quantity", whole_units("qty_sum"))


def successive_pairs(sales: DataFrame, group_cols: Sequence[str], upload_col: str) -> DataFrame:
    """Each upload paired with the group's previous upload (first one: none).

    The window runs over distinct ``(group, upload)`` keys only.
    """
    ups = sales.select(*group_cols, upload_col).distinct()
    w = Window.partitionBy(*group_cols).orderBy(upload_col)
    return ups.withColumn("prev_upload", F.lag(upload_col).over(w)) \
        .filter(F.col("prev_upload").isNotNull()) \
        .withColumnRenamed(upload_col, "curr_upload")


def fixed_pairs(sales: DataFrame, group_cols: Sequence[str], upload_col: str, prev, curr) -> DataFrame:
    """Pairs for a fixed previous/current upload, for groups that have both."""
    have = sales.filter(F.col(upload_col).isin(prev, curr)).groupBy(*group_cols) \
        .agg(F.countDistinct(upload_col).alias("_n")).filter(F.col("_n") == 2)
    return have.select(*group_cols, F.lit(prev).alias("prev_upload"), F.lit(curr).alias("curr_upload"))


def compared(sales: DataFrame, pairs: DataFrame, group_cols: Sequence[str], upload_col: str) -> DataFrame:
    """Rows of the uploads that some pair names, taken before anything is aggregated."""
    sides = [pairs.select(*group_cols, F.col(c).alias(upload_col)) for c in ("prev_upload", "curr_upload")]
    return sales.join(sides[0].unionByName(sides[1]).distinct(), [*group_cols, upload_col], "left_semi")


def _side(items: DataFrame, pairs: DataFrame, group_cols, upload_col, side: str) -> DataFrame:
    """Items of the ``prev`` or ``curr`` upload of every pair (equi-join on the upload)."""
    p = pairs.select(*group_cols, "prev_upload", "curr_upload") \
        .withColumn(upload_col, F.col(f"{side}_upload"))
    return items.join(p, [*group_cols, upload_col], "inner").drop(upload_col)


def top_panels(sales: DataFrame, pairs: DataFrame, group_cols: Sequence[str], upload_col: str,
               top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(old_panel, new_panel)``.

    old: previous top N with ``prev_rank, prev_qty, curr_qty`` (J1, missing -> 0),
    ``pct_change`` (W5) and ``status`` (J2/W6).  new: current top N with ``curr_rank``.
    """
    keys = [*group_cols, "prev_upload", "curr_upload"]
    items = upload_items(compared(sales, pairs, group_cols, upload_col), group_cols, upload_col)
    ranked = top_k(items, [*group_cols, upload_col], by_measure_then_name("qty_sum", "item_name"), top_n)
    prev_top = _side(ranked, pairs, group_cols, upload_col, "prev") \
        .select(*keys, F.col("rank").alias("prev_rank"), "item_name", F.col("quantity").alias("prev_qty"))
    curr_top = _side(ranked, pairs, group_cols, upload_col, "curr") \
        .select(*keys, F.col("rank").alias("curr_rank"), "item_name", F.col("quantity").alias("curr_qty"))
    curr_all = _side(items, pairs, group_cols, upload_col, "curr") \
        .select(*keys, "item_name", F.col("quantity").alias("curr_qty"))
    old = (prev_top.join(curr_all, [*keys, "item_name"], "left")
           .join(curr_top.select(*keys, "item_name", "curr_rank"), [*keys, "item_name"], "left")
           .select(*keys, "prev_rank", "item_name", "prev_qty",
                   F.coalesce("curr_qty", F.lit(0).cast("bigint")).alias("curr_qty"),
                   "curr_rank"))
    old = old.withColumn("pct_change", pct_change("prev_qty", "curr_qty")) \
        .withColumn("status", F.when(F.col("curr_rank").isNotNull(), F.lit(STILL_TEXT.format(n=top_n)))
                    .otherwise(F.lit(DROPPED_TEXT.format(n=top_n)))).drop("curr_rank")
    return old, curr_top


def top_sets(sales: DataFrame, pairs: DataFrame, group_cols: Sequence[str], upload_col: str,
             top_n: int = 5) -> dict[str, DataFrame]:
    """Kept (semi join), dropped and newly entered (anti joins) items."""
    keys = [*group_cols, "prev_upload", "curr_upload"]
    items = upload_items(compared(sales, pairs, group_cols, upload_col), group_cols, upload_col)
    ranked = top_k(items, [*group_cols, upload_col], by_measure_then_name("qty_sum", "item_name"), top_n)
    prev_top = _side(ranked, pairs, group_cols, upload_col, "prev").select(*keys, "item_name", "rank")
    curr_top = _side(ranked, pairs, group_cols, upload_col, "curr").select(*keys, "item_name", "rank")
    on = [*keys, "item_name"]
    return {
        "kept": prev_top.join(curr_top.select(*on), on, "left_semi"),
        "dropped": prev_top.join(curr_top.select(*on), on, "left_anti"),
        "entered": curr_top.join(prev_top.select(*on), on, "left_anti"),
    }


def full_comparison(sales: DataFrame, pairs: DataFrame, group_cols: Sequence[str],
                    upload_col: str) -> DataFrame:
    """Every item of either upload: quantities (missing -> 0), ranks over the
    full lists, ``rank_change = prev_rank - curr_rank`` (positive = moved up)."""
    keys = [*group_cols, "prev_upload", "curr_upload"]
    items = upload_items(compared(sales, pairs, group_cols, upload_col), group_cols, upload_col)
    ranked = rank_all(items, [*group_cols, upload_col], by_measure_then_name("qty_sum", "item_name"))
    prev = _side(ranked, pairs, group_cols, upload_col, "prev") \
        .select(*keys, "item_name", F.col("quantity").alias("previous"), F.col("rank").alias("prev_rank"))
    curr = _side(ranked, pairs, group_cols, upload_col, "curr") \
        .select(*keys, "item_name", F.col("quantity").alias("current"), F.col("rank").alias("curr_rank"))
    j = prev.join(curr, [*keys, "item_name"], "full_outer")
    zero = F.lit(0).cast("bigint")
    return j.select(*keys, "item_name",
                    F.coalesce("previous", zero).alias("previous"),
                    F.coalesce("current", zero).alias("current"),
                    pct_change(F.coalesce("previous", zero), F.coalesce("current", zero)).alias("percent_change"),
                    "prev_rank", "curr_rank",
                    (F.col("prev_rank") - F.col("curr_rank")).alias("rank_change"))

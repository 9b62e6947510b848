"""Data-quality operators (Q2, Q3; Q1 comes out of ingest).

Q2 reconciles category subtotal rows (blank item name, as POS exports write
them) with the sum of the item rows; Q3 reports exact duplicate rows.  Both are
plain aggregates, partial-aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import money_out, whole_units
from ..functions.text import strip_text


def with_subtotals(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Append one blank-name subtotal row per (group, category), the way a
    menu-breakdown export carries them."""
    cols = [*group_cols, "category", "item_name", "quantity", "net_sales"]
    subs = sales.groupBy(*group_cols, "category").agg(
        F.sum("quantity").cast("decimal(18,4)").alias("quantity"),
        F.sum("net_sales").cast("decimal(18,4)").alias("net_sales")) \
        .withColumn("item_name", F.lit(""))
    return sales.select(*cols).unionByName(subs.select(*cols))


def reconcile_subtotals(rows: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Q2: per category, subtotal rows vs the sum of item rows, and the difference."""
    blank = strip_text(F.coalesce(F.col("item_name"), F.lit(""))) == ""
    s = rows.groupBy(*group_cols, "category").agg(
        F.sum(F.when(~blank, F.col("quantity"))).alias("iq"),
        F.sum(F.when(~blank, F.col("net_sales"))).alias("inet"),
        F.sum(F.when(blank, F.col("quantity"))).alias("sq"),
        F.sum(F.when(blank, F.col("net_sales"))).alias("snet"))
    zero = F.lit(0)
    return s.select(*group_cols, "category",
                    whole_units(F.coalesce("iq", zero)).alias("item_qty"),
                    money_out(F.coalesce("inet", zero)).alias("item_net"),
                    whole_units(F.coalesce("sq", zero)).alias("subtotal_qty"),
                    money_out(F.coalesce("snet", zero)).alias("subtotal_net"),
                    whole_units(F.coalesce("sq", zero) - F.coalesce("iq", zero)).alias("qty_diff"),
                    money_out(F.coalesce("snet", zero) - F.coalesce("inet", zero)).alias("net_diff"))


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q3: rows that occur more than once over ``cols``, with their count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)

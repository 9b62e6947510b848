"""Item, category and group aggregates.

All functions take the canonical ``sales`` table and a list of group columns
(``store_id``, ``period`` …; empty = the whole table as one export).  Sums run
on DECIMAL (contract C2); partial aggregation happens map-side, so one hot
store or item only ships one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import money_out, mean_out, ratio_pct, whole_units, by_measure_then_name
from ..functions.text import strip_text, date_text_short, period_text
from .ranking import join_on_group, top_k


def item_sums(sales: DataFrame, group_cols: Sequence[str], with_revenue: bool = True) -> DataFrame:
    """Exact per-item sums: ``quantity``, ``net_sales``, ``price_sum``, ``price_n``."""
    aggs = [F.sum("quantity").alias("qty_sum")]
    if with_revenue:
        aggs += [F.sum("net_sales").alias("net_sum"),
                 F.sum("avg_price").alias("price_sum"),
                 F.count("avg_price").alias("price_n")]
    return sales.groupBy(*group_cols, "item_name").agg(*aggs)


def item_list(sales: DataFrame, group_cols: Sequence[str], with_revenue: bool = True) -> DataFrame:
    """Item rows as the reference hands them out: int quantity, 2-place money."""
    return item_rows(item_sums(sales, group_cols, with_revenue), group_cols, with_revenue)


def item_rows(sums: DataFrame, group_cols: Sequence[str], with_revenue: bool = True) -> DataFrame:
    """``item_sums`` rounded for output."""
    cols = [*group_cols, "item_name", whole_units("qty_sum").alias("quantity")]
    if with_revenue:
        cols += [money_out("net_sum").alias("net_sales"),
                 mean_out("price_sum", "price_n").alias("avg_price")]
    # keep the exact sum for ordering (C1: measure desc, name asc)
    return sums.select(*cols, F.col("qty_sum"))


def top_items(sales: DataFrame, group_cols: Sequence[str] = (), n: int = 5,
              with_revenue: bool = True) -> DataFrame:
    """A1 / A2 + O1: top ``n`` items by quantity, ties by name."""
    return top_item_rows(item_sums(sales, group_cols, with_revenue), group_cols, n, with_revenue)


def top_item_rows(sums: DataFrame, group_cols: Sequence[str], n: int = 5, with_revenue: bool = True) -> DataFrame:
    ranked = top_k(item_rows(sums, group_cols, with_revenue), group_cols, by_measure_then_name("qty_sum", "item_name"), n)
    return ranked.drop("qty_sum")


def all_items(sales: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A3: every item with its whole-unit quantity; null names kept, names trimmed.

    pandas ``astype(str)`` renders a null key as ``'nan'``; the same text is used.
    The list is returned sorted (range-partitioned global sort, O2).
    """
    s = sales.groupBy(*group_cols, "item_name").agg(F.sum("quantity").alias("qty_sum"))
    name = F.coalesce(strip_text(F.col("item_name")), F.lit("nan"))
    out = s.select(*group_cols, name.alias("item_name"),
                   whole_units("qty_sum").alias("quantity"), "qty_sum")
    return out.orderBy(*[F.col(c) for c in group_cols],
                       *by_measure_then_name("qty_sum", "item_name")).drop("qty_sum")


def category_list(sales: DataFrame, group_cols: Sequence[str], with_revenue: bool = True,
                  has_revenue: Column | None = None) -> DataFrame:
    """Category sums; null categories drop out (pandas ``groupby`` default, C5).

    ``has_revenue``: a flag on the rows that is the same all over a group, for tables where
    some groups have a revenue column and others don't."""
    aggs = [F.sum("quantity").alias("qty_sum")]
    if with_revenue:
        aggs.append(F.sum("net_sales").alias("net_sum"))
        aggs.append(F.max(F.lit(True) if has_revenue is None else has_revenue).alias("has_rev"))
    return category_rows(sales.filter(F.col("category").isNotNull()).groupBy(*group_cols, "category").agg(*aggs), group_cols, with_revenue)


def category_rows(s: DataFrame, group_cols: Sequence[str], with_revenue: bool = True) -> DataFrame:
    """Category sums rounded for output."""
    cols = [*group_cols, "category", whole_units("qty_sum").alias("quantity"), "qty_sum"]
    if with_revenue:
        cols += [F.when(F.col("has_rev"), money_out("net_sum")).alias("net_sales"), "net_sum", "has_rev"]
    return s.select(*cols)


def top_categories(sales: DataFrame, group_cols: Sequence[str] = (), n: int = 5,
                   with_revenue: bool = True, has_revenue: Column | None = None) -> DataFrame:
    """A4 (by revenue) / A5 (by quantity): top ``n`` categories, ties by name.  With a
    ``has_revenue`` flag each group takes the measure that it has."""
    return top_category_rows(category_list(sales, group_cols, with_revenue, has_revenue), group_cols, n, with_revenue)


def top_category_rows(cats: DataFrame, group_cols: Sequence[str], n: int = 5, with_revenue: bool = True) -> DataFrame:
    if with_revenue:
        cats = cats.withColumn("measure", F.when(F.col("has_rev"), F.col("net_sum")).otherwise(F.col("qty_sum")))
    measure = "measure" if with_revenue else "qty_sum"
    ranked = top_k(cats, group_cols, by_measure_then_name(measure, "category"), n)
    return ranked.drop("qty_sum", "net_sum", "has_rev", "measure")


def group_totals(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A6 + A8: total revenue, total discount and the discount share of gross."""
    s = sales.groupBy(*group_cols).agg(F.sum("net_sales").alias("net_sum"),
                                       F.sum("discount_amount").alias("disc_sum"))
    return s.select(*group_cols,
                    money_out("net_sum").alias("total_revenue"),
                    money_out("disc_sum").alias("total_discount"),
                    ratio_pct("disc_sum", F.col("net_sum") + F.col("disc_sum")).alias("discount_pct"))


def category_share(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Each category's share of its group's revenue, in percent.

    The group total is an aggregate joined back (one row per group), not a
    window over all category rows of the group.
    """
    cats = category_list(sales, group_cols, with_revenue=True)
    totals = sales.groupBy(*group_cols).agg(F.sum("net_sales").alias("total_sum"))
    j = join_on_group(cats, totals, group_cols)
    return j.select(*group_cols, "category", "net_sales",
                    ratio_pct("net_sum", "total_sum").alias("share_pct"))


def date_range(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """First and last date as ``Mar 01, 2025``; no row when there is no date."""
    s = sales.filter(F.col("date").isNotNull()).groupBy(*group_cols).agg(
        F.min("date").alias("d_min"), F.max("date").alias("d_max"))
    return s.select(*group_cols, date_text_short("d_min").alias("start"),
                    date_text_short("d_max").alias("end"))


def data_period(sales: DataFrame, group_cols: Sequence[str], date_col: str = "date") -> DataFrame:
    """A10: ``March 1, 2025 – April 5, 2025`` (one date when first = last).

    ``date_col`` may be text: unparsable dates are ignored (lenient parse, F4).
    """
    d = F.col(date_col)
    if dict(sales.dtypes).get(date_col) == "string":
        from ..functions.coerce import lenient_date
        d = lenient_date(d)
    s = sales.select(*group_cols, d.alias("_d")).filter(F.col("_d").isNotNull()) \
        .groupBy(*group_cols).agg(F.min("_d").alias("d_min"), F.max("_d").alias("d_max"))
    return s.select(*group_cols, period_text("d_min", "d_max").alias("data_period"))


def month_category(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Quantity by month name (years collapsed, as the reference) and category."""
    s = sales.filter(F.col("date").isNotNull() & F.col("category").isNotNull()) \
        .groupBy(*group_cols, F.date_format("date", "MMMM").alias("month"), "category") \
        .agg(F.sum("quantity").alias("qty_sum"))
    return s.select(*group_cols, "month", "category", whole_units("qty_sum").alias("quantity"))

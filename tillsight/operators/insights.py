"""Row-level picks, top category, monthly trend and the insight list.

Row-level picks (best seller row, top revenue row, top premium row) take two steps: one
hash aggregate gives totals and maxima, and the first row in export order among the
few that reach a maximum wins, like pandas ``idxmax``.  Category and month trends are small second
aggregates joined back on the group key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import money_out, ratio_pct, whole_units
from ..functions.text import fixed_text, money_text, plain_money_text
from ..session import scratch_path, slice_count, slice_of, write_lean
from .ranking import join_on_group, top_k
from .shared import CATEGORY, FLAGS, MONTH, TOTAL, part_of, premium_quantity, shared_sums

# Insight kinds, in the order they are listed.
KIND_BESTSELLER = "bestseller"
KIND_REVENUE = "revenue"
KIND_TOP_REVENUE = "top_revenue"
KIND_DISCOUNT = "discount"
KIND_PREMIUM = "premium"
KIND_TREND = "trend"
KIND_INFO = "info"
NO_DATA_TEXT = "No data available for insights"


#: Buckets of groups of which a lower bound is broadcast; a row each.
PEAK_BUCKETS = 65_536


def _near_peaks(sales: DataFrame, peaks: DataFrame, group_cols: Sequence[str], hits: dict[str, tuple[Column, str]]) -> DataFrame:
    """The rows that may reach a peak, so that the join by group shuffles these only.  Groups are dealt into buckets by hash; a row
    below the least peak of its bucket is below that of its group.  The bounds are one row a bucket however many groups there are."""
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in group_cols]), F.lit(PEAK_BUCKETS))
    least = peaks.groupBy(bucket.alias("_bucket")).agg(*[F.min(peak).alias(f"_least_{h}") for h, (_, peak) in hits.items()])
    near = F.lit(False)
    for h, (measure, _) in hits.items():
        near = near | F.coalesce(measure >= F.col(f"_least_{h}"), F.lit(False))
    return sales.join(F.broadcast(least), bucket == F.col("_bucket")).filter(near).select(*sales.columns)


def _peak_rows(sales: DataFrame, peaks: DataFrame, group_cols: Sequence[str], hits: dict[str, tuple[Column, str]]) -> DataFrame:
    """The few rows that reach a peak of their group.  ``hits``: flag -> (measure, its peak).  ``peaks`` has the maxima,
    a hash aggregate over plain numbers; so the rows themselves are never sorted."""
    if group_cols:
        sales = _near_peaks(sales, peaks, group_cols, hits)
    j = join_on_group(sales, peaks, group_cols).withColumns({h: _equals(measure, peak) for h, (measure, peak) in hits.items()})
    any_hit = F.lit(False)
    for h in hits:
        any_hit = any_hit | F.col(h)
    return j.filter(any_hit)


def _first(value: Column, hit: str, order_col: str) -> Column:
    """Value of the first of the flagged rows in row order (pandas ``idxmax`` takes the first)."""
    return F.min_by(value, F.when(F.col(hit), F.col(order_col)))


def _equals(measure: Column, peak: str) -> Column:
    return F.coalesce(measure == F.col(peak), F.lit(False))


def row_picks(sales: DataFrame, totals: DataFrame, group_cols: Sequence[str], premium_price: float = 15.0,
              order_col: str = "row_key") -> DataFrame:
    """``totals`` (one row a group, with its maxima) and the three arg-max rows among the few
    that reach a maximum."""
    premium = premium_quantity(premium_price)
    peaks = totals.select(*group_cols, "max_qty", "max_net", "max_prem")
    rows = _peak_rows(sales, peaks, group_cols, {
        "_is_best": (F.col("quantity"), "max_qty"), "_is_rev": (F.col("net_sales"), "max_net"), "_is_prem": (premium, "max_prem")})
    picks = rows.groupBy(*group_cols).agg(
        _first(F.struct("item_name", "quantity"), "_is_best", order_col).alias("best"),
        _first(F.struct("item_name", "net_sales"), "_is_rev", order_col).alias("top_rev"),
        _first(F.struct("item_name", "avg_price", "quantity"), "_is_prem", order_col).alias("premium"))
    return join_on_group(totals, picks, group_cols, "left")


def _peak_row(sales: DataFrame, group_cols: Sequence[str], measure: str, value: Column, order_col: str) -> DataFrame:
    peaks = sales.groupBy(*group_cols).agg(F.max(measure).alias("_max"))
    rows = _peak_rows(sales, peaks, group_cols, {"_is": (F.col(measure), "_max")})
    return rows.groupBy(*group_cols).agg(_first(value, "_is", order_col).alias("b"))


def best_seller(sales: DataFrame, group_cols: Sequence[str], order_col: str = "row_key") -> DataFrame:
    """The single sales row with the most units (not the item total)."""
    s = _peak_row(sales, group_cols, "quantity", F.struct("item_name", "quantity"), order_col)
    return s.select(*group_cols, F.col("b.item_name").alias("item_name"),
                    whole_units("b.quantity").alias("quantity"))


def top_revenue_row(sales: DataFrame, group_cols: Sequence[str], order_col: str = "row_key") -> DataFrame:
    """The single sales row with the highest net sales."""
    s = _peak_row(sales, group_cols, "net_sales", F.struct("item_name", "net_sales"), order_col)
    return s.select(*group_cols, F.col("b.item_name").alias("item_name"),
                    money_out("b.net_sales").alias("net_sales"))


def top_premium_row(sales: DataFrame, group_cols: Sequence[str], premium_price: float = 15.0,
                    order_col: str = "row_key") -> DataFrame:
    """Among rows with ``avg_price > premium_price`` the one with most units."""
    hv = sales.filter(F.col("avg_price") > F.lit(premium_price))
    s = _peak_row(hv, group_cols, "quantity", F.struct("item_name", "avg_price", "quantity"), order_col)
    return s.select(*group_cols, F.col("b.item_name").alias("item_name"),
                    money_out("b.avg_price").alias("avg_price"),
                    whole_units("b.quantity").alias("quantity"))


def top_revenue_category(sales: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A12 + A7: category with the highest revenue (alphabetical on ties), its
    revenue and its share of the group's revenue."""
    cats = sales.filter(F.col("category").isNotNull()).groupBy(*group_cols, "category") \
        .agg(F.sum("net_sales").alias("cat_sum"))
    top = cats.groupBy(*group_cols).agg(
        F.min_by(F.struct("category", "cat_sum"),
                 F.struct((-F.col("cat_sum")).alias("m"), F.col("category"))).alias("t"))
    totals = sales.groupBy(*group_cols).agg(F.sum("net_sales").alias("total_sum"))
    j = join_on_group(top, totals, group_cols)
    return j.select(*group_cols, F.col("t.category").alias("category"),
                    money_out("t.cat_sum").alias("net_sales"),
                    ratio_pct("t.cat_sum", "total_sum").alias("share_pct"))


def monthly_trend(sales: DataFrame, group_cols: Sequence[str], max_months: int = 2,
                  by_year: bool = False) -> DataFrame:
    """Per month the category with most units (alphabetical on ties); months
    taken in name order (the reference's group order), first ``max_months``.

    ``by_year=True`` keeps years apart (``MMMM yyyy``) instead of collapsing them.
    """
    fmt = "MMMM yyyy" if by_year else "MMMM"
    mc = sales.filter(F.col("date").isNotNull() & F.col("category").isNotNull()) \
        .groupBy(*group_cols, F.date_format("date", fmt).alias("month"), "category") \
        .agg(F.sum("quantity").alias("qty_sum"))
    return trend_rows(mc, group_cols, max_months)


def trend_rows(mc: DataFrame, group_cols: Sequence[str], max_months: int = 2) -> DataFrame:
    """A16 from the units by month and category."""
    top = mc.groupBy(*group_cols, "month").agg(
        F.min_by("category", F.struct((-F.col("qty_sum")).alias("m"), F.col("category"))).alias("category"))
    ranked = top_k(top, group_cols, [F.col("month")], max_months, rank_col="month_rank")
    return ranked.select(*group_cols, "month_rank", "month", "category",
                         F.concat(F.lit("Higher "), F.lower("category"), F.lit(" sales in "),
                                  F.col("month")).alias("text"))


def insights(sales: DataFrame, group_cols: Sequence[str], premium_price: float = 15.0,
             order_col: str = "row_key", flags: dict[str, Column] | None = None,
             max_insights: int = 5, max_with_trend: int = 3, uploads: DataFrame | None = None,
             sums: dict[str, DataFrame] | None = None, gathered: bool = False) -> DataFrame:
    """The ordered insight list per group as rows ``(…group, seq, type, text)``.

    ``uploads``: the groups there are, one row each; those without sales rows get the information row.

    ``flags`` says which source columns existed in the export (``has_net_sales``,
    ``has_discount``, ``has_avg_price``, ``has_date``); a nullable fixed schema
    cannot tell an absent column from an all-null one.  Defaults: all present.  ``sums``: the shared sums, if they
    are there already; the sales are read once for them and once for the rows that reach a maximum.  ``gathered``: see ``shared_sums``.
    """
    group_cols = list(group_cols)
    own, n = sums is None, slice_count(sales) if group_cols else 1
    if own:
        sums = shared_sums(sales, group_cols, premium_price, flags, (TOTAL, CATEGORY, MONTH), gathered)

    def by_slice(make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], name: str) -> DataFrame:
        """Of large sales, each slice of groups is written before the next one is made."""
        if n == 1:
            return make(lambda df: df)
        path = scratch_path(sales.sparkSession, name)
        for k in range(n):
            write_lean(make(lambda df: slice_of(df, group_cols, n, k)), path, mode="append")
        return sales.sparkSession.read.parquet(path)

    totals = part_of(sums, TOTAL).select(*group_cols, "n_rows", "net_sum", "disc_sum", "max_qty", "max_net", "max_prem", *[F.col(f).alias(f"_{f}") for f in FLAGS])
    cat = by_slice(lambda mine: mine(part_of(sums, CATEGORY)).groupBy(*group_cols).agg(
        F.min_by(F.struct("category", F.col("net_sum").alias("cat_sum")),
                 F.struct((-F.col("net_sum")).alias("m"), F.col("category"))).alias("topcat")), "insight-categories")
    trend = by_slice(lambda mine: trend_rows(mine(part_of(sums, MONTH)), group_cols, max_months=12).groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct("month_rank", "text"))).alias("trends")), "insight-trends")
    if own and n > 1:
        sums.drop(sales.sparkSession, CATEGORY, MONTH)
    picks = by_slice(lambda mine: row_picks(mine(sales), mine(totals), group_cols, premium_price, order_col), "insight-picks")

    j = join_on_group(picks, cat, group_cols, "left")
    j = join_on_group(j, trend, group_cols, "left")

    def item(kind: str, text: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), text.alias("text")))

    rev_gate = F.col("_has_net_sales") & (F.coalesce(F.col("net_sum"), F.lit(0)) > 0)
    pct_text = fixed_text(ratio_pct("topcat.cat_sum", "net_sum"), 0)
    disc_pct = ratio_pct("disc_sum", F.col("net_sum") + F.col("disc_sum"))
    base = F.array(
        item(KIND_BESTSELLER,
             F.concat(F.col("best.item_name"), F.lit(" is the top seller with "),
                      whole_units("best.quantity").cast("string"), F.lit(" units sold")),
             F.col("best").isNotNull()),
        item(KIND_REVENUE,
             F.concat(F.col("topcat.category"), F.lit(" drives "), pct_text,
                      F.lit("% of total revenue ("), money_text("topcat.cat_sum"), F.lit(")")),
             rev_gate & F.col("topcat").isNotNull()),
        item(KIND_TOP_REVENUE,
             F.concat(F.col("top_rev.item_name"), F.lit(" generates the most revenue at "),
                      money_text("top_rev.net_sales")),
             rev_gate & F.col("top_rev").isNotNull()),
        item(KIND_DISCOUNT,
             F.concat(F.lit("Total discounts: "), money_text("disc_sum"), F.lit(" ("),
                      fixed_text(disc_pct, 1), F.lit("% of gross sales)")),
             rev_gate & F.col("_has_discount") & (F.coalesce(F.col("disc_sum"), F.lit(0)) > 0)),
        item(KIND_PREMIUM,
             F.concat(F.col("premium.item_name"), F.lit(" is the top premium item ("),
                      plain_money_text("premium.avg_price"), F.lit(" avg) with "),
                      whole_units("premium.quantity").cast("string"), F.lit(" sales")),
             rev_gate & F.col("_has_avg_price") & F.col("premium").isNotNull()),
    )
    base = F.filter(base, lambda x: x.isNotNull())
    trend_items = F.transform(F.coalesce(F.col("trends"), F.array().cast(
        "array<struct<month_rank:int,text:string>>")),
        lambda t: F.struct(F.lit(KIND_TREND).alias("type"), t["text"].alias("text")))
    use_trend = ~rev_gate & F.col("_has_date")
    all_items = F.when(use_trend, F.slice(F.concat(base, trend_items), 1, max_with_trend)) \
        .otherwise(F.slice(base, 1, max_insights))
    out = j.select(*group_cols, F.posexplode(all_items).alias("pos", "ins"))
    out = out.select(*group_cols, (F.col("pos") + 1).alias("seq"), F.col("ins.type").alias("type"), F.col("ins.text").alias("text"))
    if uploads is None:
        return out
    empty = uploads.select(*group_cols).join(picks.select(*group_cols), group_cols, "left_anti")
    return out.unionByName(empty.select(*group_cols, F.lit(1).alias("seq"), F.lit(KIND_INFO).alias("type"), F.lit(NO_DATA_TEXT).alias("text")))

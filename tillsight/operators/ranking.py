"""Top-k, ranks and the per-group benchmark join.

Per-group top-k is ``row_number() <= k`` over ``partitionBy(group)``; Catalyst
turns the filter into a ``WindowGroupLimit`` that keeps only k rows per group
*before* the shuffle, so a hot group ships at most k rows per map task.
Without group columns it is ``orderBy().limit()`` = ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

ALL_KEY = "_all_rows"


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` and number them 1..k."""
    group_cols = list(group_cols)
    if not group_cols:
        limited = df.orderBy(*order).limit(k)
        # at most k rows: numbering them in one partition is bounded work
        return limited.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


#: Rows up to which a group is ranked by one window task.
GROUP_ROWS = 2_000_000


def rank_all(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
             rank_col: str = "rank") -> DataFrame:
    """Rank every row of its group (W4 over full lists).

    The rows are written once, so their number is known from the files.  Only a table of more than ``GROUP_ROWS`` rows can
    have a group of as many; then the groups are counted, and the large ones ranked over ranges of their order, in many tasks.
    """
    group_cols = list(group_cols)
    if not group_cols:
        # global order: range-partitioned sort, then a per-partition offset
        return _range_rank(df, [], order, rank_col)
    number = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order))
    df = stored(df, "rank-rows")
    if df.count() <= GROUP_ROWS:
        return df.withColumn(rank_col, number)
    large = stored(df.groupBy(*group_cols).count().filter(F.col("count") > GROUP_ROWS).select(*group_cols), "large-groups")
    others = df.join(large, group_cols, "left_anti").withColumn(rank_col, number)
    return others.unionByName(_range_rank(df.join(large, group_cols, "left_semi"), group_cols, order, rank_col))


def _range_rank(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], rank_col: str) -> DataFrame:
    """Row numbers over the whole table, or over each group, without pulling one into one partition.

    The table is range-partitioned by group and order, numbered within each range and written once
    with its range number, so both branches below see the same ranges.  A count per range and group, one
    row each, gives the offsets."""
    ranged = df.repartitionByRange(*[F.col(c) for c in group_cols], *order).withColumn("_pid", F.spark_partition_id())
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", *group_cols).orderBy(*order)))
    local = stored(local, "range-rank")
    counts = local.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"))
    ranges = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    before = ranges.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a group
    offsets = counts.select(F.col("_pid").alias("_range"), *[F.col(c).alias(f"_of_{c}") for c in group_cols], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = F.col("_pid") == F.col("_range")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rank = F.col("_off") + F.col("_local")
    return local.join(offsets, same).select(*df.columns, (rank.cast("int") if group_cols else rank).alias(rank_col))


def with_group_max(df: DataFrame, group_cols: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Attach per-group maxima (A17) by aggregate + join, not an unbounded window.

    ``measures`` maps source column -> output column.  Without group columns the
    one-row aggregate is joined on a constant key (broadcast: one row).
    """
    group_cols = list(group_cols)
    aggs = [F.max(src).alias(dst) for src, dst in measures.items()]
    if not group_cols:
        bench = df.agg(*aggs).withColumn(ALL_KEY, F.lit(0))
        return (df.withColumn(ALL_KEY, F.lit(0))
                .join(F.broadcast(bench), ALL_KEY).drop(ALL_KEY))
    bench = df.groupBy(*group_cols).agg(*aggs)
    return df.join(bench, group_cols)


def join_on_group(df: DataFrame, small: DataFrame, group_cols: Sequence[str],
                  how: str = "inner") -> DataFrame:
    """Join per-group values back; with no group columns ``small`` has one row and
    is broadcast on a constant key (never a cross join)."""
    group_cols = list(group_cols)
    if group_cols:
        return df.join(small, group_cols, how)
    return (df.withColumn(ALL_KEY, F.lit(0))
            .join(F.broadcast(small.withColumn(ALL_KEY, F.lit(0))), ALL_KEY, how)
            .drop(ALL_KEY))

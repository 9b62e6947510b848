"""Typed sales table from the driver's parquet tables.

``sales_view`` turns ``lineitem ⋈ part`` into the canonical sales schema
(SURVEY §1, §7.2):

    store_id  <- l_suppkey            period <- year(l_shipdate)
    item_name <- p_name               category <- p_type
    quantity  <- l_quantity           gross_sales <- l_extendedprice
    discount_amount <- gross * l_discount        net_sales <- gross - discount
    avg_price <- gross / quantity, half-up to 6 places (exact integer arithmetic)
    row_key   <- unique row order (l_orderkey, l_linenumber, l_partkey,
                 l_suppkey, l_shipdate, l_quantity, l_extendedprice)

Join strategy: no hint.  Catalyst broadcasts ``part`` only while its estimated
size (parquet footer statistics, after column pruning) is below
``spark.sql.autoBroadcastJoinThreshold``; past that it plans a sort-merge join on
``partkey`` and AQE may still switch to a broadcast or split skewed partitions at
run time.  So the broadcast is always behind a size check, with a shuffle join
beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

ROW_KEY_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unit_price(gross_col: str = "gross_sales", qty_col: str = "quantity"):
    """gross / quantity rounded half-up to 6 places, computed on exact integers.

    Both inputs are decimals with at most 4 places, so ``g4 = gross*1e4`` and
    ``q4 = qty*1e4`` are integers and ``(2*g4*1e6 + q4) div (2*q4)`` is the
    half-up rounded quotient in millionths.  Long arithmetic keeps it on the
    fast path (a row's gross must stay below 4.6e8; ANSI mode raises past it).
    Null when quantity is not positive.
    """
    g4 = f"cast({gross_col} * 10000 as bigint)"
    q4 = f"cast({qty_col} * 10000 as bigint)"
    return F.expr(
        f"CASE WHEN {qty_col} > 0 THEN cast(cast(({g4} * 2000000 + {q4}) div ({q4} * 2) AS decimal(18,0)) "
        f"* cast(0.000001 AS decimal(6,6)) AS decimal(18,6)) END")


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows as the tables have them; ``sales_columns`` derives the sales schema from them."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").drop("p_partkey")


def sales_columns(rows: DataFrame) -> DataFrame:
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = gross * F.col("l_discount").cast("decimal(4,2)")
    out = rows.select(
        F.col("l_suppkey").alias("store_id"),
        F.year("l_shipdate").alias("period"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("item_name"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
        gross.alias("gross_sales"),
        disc.cast("decimal(18,4)").alias("discount_amount"),
        (gross - disc).cast("decimal(18,4)").alias("net_sales"),
        F.struct(*[F.col(c) for c in ROW_KEY_COLS]).alias("row_key"),
    )
    return out.withColumn("avg_price", unit_price())


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_columns(sales_rows(spark, sf_dir))

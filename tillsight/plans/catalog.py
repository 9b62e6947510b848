"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Results are flat rows
(nested lists are exploded to rank columns) so they can be compared with the
oracle row by row.  Numeric outputs are BIGINT / INT / DOUBLE / STRING on both
sides; money is rounded on the exact decimal before it becomes DOUBLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import insights as ins
from ..operators import labels as lab
from ..operators.ranking import rank_all
from ..contracts import money_out as _money_out
from ..session import scratch_path, stored, stored_lean, write_lean
from ..operators.shared import together
from ..sources import published
from ..sources.tables import sales_columns, sales_rows, sales_view

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# premium threshold on the driver tables: mean unit price there is ~4,765
PREMIUM_PRICE = 5000.0
STORE = ["store_id"]


def query(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- oracle parts
SALES_CTE = """sales AS (
  SELECT l_suppkey AS store_id, CAST(year(l_shipdate) AS INTEGER) AS period,
         p_type AS category, p_name AS item_name, CAST(l_shipdate AS DATE) AS date,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              - CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS net_sales,
         CASE WHEN l_quantity > 0 THEN CAST(
              ((CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 10000 AS BIGINT) * 2000000
                + CAST(CAST(l_quantity AS DECIMAL(18,4)) * 10000 AS BIGINT))
               // (CAST(CAST(l_quantity AS DECIMAL(18,4)) * 10000 AS BIGINT) * 2)) * 0.000001
              AS DECIMAL(18,6)) END AS avg_price,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"


def money_sql(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def int_sql(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def mean_sql(total: str, n: str) -> str:
    """Half-up mean to 2 places on exact integers (DuckDB decimal / int is DOUBLE)."""
    return (f"CAST((CAST({total} * 1000000 AS HUGEINT) * 2 + {n} * 10000) // ({n} * 20000) AS DOUBLE) / 100")


def pct_sql(num: str, den: str) -> str:
    return (f"CASE WHEN CAST({den} AS DOUBLE) = 0 THEN NULL "
            f"ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100 END")


def money_text_sql(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', round({x}, 2))"


def sq(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def with_sales(body: str) -> str:
    return f"WITH {SALES_CTE},\n{body}"


def _sales(spark, sf_dir):
    return sales_view(spark, sf_dir)


def _sales_table(spark, sf_dir):
    """The sales view written once as a table, for queries that read it in
    several branches (in production this is the ingest's output table)."""
    return stored(sales_view(spark, sf_dir), "sales-view")


def _gathered_sales(spark, sf_dir):
    """The sales view over the joined rows, which are written once with those of a store side by side and without derived columns."""
    return sales_columns(stored(together(sales_rows(spark, sf_dir), ["l_suppkey"]), "sales-rows"))


# ---------------------------------------------------------------- A1-A5, O1-O3
ITEMS_SQL = """items AS (
  SELECT {g} item_name, sum(quantity) AS q, sum(net_sales) AS n,
         sum(avg_price) AS ps, count(avg_price) AS pn
  FROM sales GROUP BY {g} item_name)"""


@query("top_items_revenue", with_sales(ITEMS_SQL.format(g="") + f"""
SELECT CAST(row_number() OVER (ORDER BY q DESC, item_name) AS INTEGER) AS rank, item_name,
       {int_sql('q')} AS quantity, {money_sql('n')} AS net_sales, {mean_sql('ps', 'pn')} AS avg_price
FROM items ORDER BY q DESC, item_name LIMIT 5"""))
def q_top_items_revenue(spark, sf_dir):
    return agg.top_items(_sales(spark, sf_dir), [], 5, with_revenue=True)


@query("top_items_quantity", with_sales(ITEMS_SQL.format(g="") + f"""
SELECT CAST(row_number() OVER (ORDER BY q DESC, item_name) AS INTEGER) AS rank, item_name,
       {int_sql('q')} AS quantity
FROM items ORDER BY q DESC, item_name LIMIT 5"""))
def q_top_items_quantity(spark, sf_dir):
    return agg.top_items(_sales(spark, sf_dir), [], 5, with_revenue=False)


@query("global_item_rank", with_sales(ITEMS_SQL.format(g="store_id,") + f"""
SELECT store_id, item_name, {int_sql('q')} AS quantity, row_number() OVER (ORDER BY q DESC, item_name, store_id) AS rank FROM items"""))
def q_global_item_rank(spark, sf_dir):
    """W4 without a group: every (store, item) ranked over the whole table."""
    items = agg.item_list(_sales(spark, sf_dir), STORE, with_revenue=False)
    return rank_all(items, [], [F.col("qty_sum").desc(), F.col("item_name"), F.col("store_id")]).select(
        "store_id", "item_name", "quantity", "rank")


@query("all_items", with_sales(ITEMS_SQL.format(g="store_id,") + f"""
SELECT store_id, coalesce(trim(item_name), 'nan') AS item_name, {int_sql('q')} AS quantity FROM items"""))
def q_all_items(spark, sf_dir):
    return agg.all_items(_sales(spark, sf_dir), STORE)


@query("top_items_per_store", with_sales(ITEMS_SQL.format(g="store_id,") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY q DESC, item_name) AS rk FROM items)
SELECT store_id, CAST(rk AS INTEGER) AS rank, item_name, {int_sql('q')} AS quantity,
       {money_sql('n')} AS net_sales, {mean_sql('ps', 'pn')} AS avg_price
FROM ranked WHERE rk <= 5"""))
def q_top_items_per_store(spark, sf_dir):
    return agg.top_items(_sales(spark, sf_dir), STORE, 5, with_revenue=True)


CATS_SQL = """cats AS (
  SELECT store_id, category, sum(quantity) AS q, sum(net_sales) AS n
  FROM sales WHERE category IS NOT NULL GROUP BY store_id, category)"""


@query("top_categories_revenue", with_sales(CATS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS rk FROM cats)
SELECT store_id, CAST(rk AS INTEGER) AS rank, category, {int_sql('q')} AS quantity, {money_sql('n')} AS net_sales
FROM ranked WHERE rk <= 5"""))
def q_top_categories_revenue(spark, sf_dir):
    return agg.top_categories(_sales(spark, sf_dir), STORE, 5, with_revenue=True)


@query("top_categories_quantity", with_sales(CATS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY q DESC, category) AS rk FROM cats)
SELECT store_id, CAST(rk AS INTEGER) AS rank, category, {int_sql('q')} AS quantity
FROM ranked WHERE rk <= 5"""))
def q_top_categories_quantity(spark, sf_dir):
    return agg.top_categories(_sales(spark, sf_dir), STORE, 5, with_revenue=False)


# ---------------------------------------------------------------- W1-W3
@query("category_badges", with_sales(CATS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS rk FROM cats)
SELECT store_id, CAST(rk AS INTEGER) AS rank, category, {int_sql('q')} AS quantity, {money_sql('n')} AS net_sales,
       CASE WHEN rk = 1 THEN 'High Revenue Driver' END AS badge
FROM ranked WHERE rk <= 5"""))
def q_category_badges(spark, sf_dir):
    top = agg.top_categories(_sales(spark, sf_dir), STORE, 5, with_revenue=True)
    return lab.category_badges(top)


@query("item_badges", with_sales(ITEMS_SQL.format(g="store_id,") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY q DESC, item_name) AS rk FROM items),
top AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY round(n, 2) DESC, rk) AS rr
        FROM ranked WHERE rk <= 5)
SELECT store_id, CAST(rk AS INTEGER) AS rank, item_name, {int_sql('q')} AS quantity,
       {money_sql('n')} AS net_sales, {mean_sql('ps', 'pn')} AS avg_price,
       CASE WHEN rk = 1 AND rr = 1 THEN 'Hot Seller, Premium Performer'
            WHEN rk = 1 THEN 'Hot Seller' WHEN rr = 1 THEN 'Premium Performer' END AS badge
FROM top"""))
def q_item_badges(spark, sf_dir):
    top = agg.top_items(_sales(spark, sf_dir), STORE, 5, with_revenue=True)
    return lab.item_badges(top, STORE)


def _tag_sql(with_rev: bool) -> str:
    rev = money_sql('n') if with_rev else "0.0"
    price = mean_sql('ps', 'pn') if with_rev else "0.0"
    extra = (f", {money_sql('n')} AS net_sales, {mean_sql('ps', 'pn')} AS avg_price" if with_rev else "")
    return with_sales(ITEMS_SQL.format(g="store_id,") + f""",
lst AS (SELECT store_id, item_name, {int_sql('q')} AS quantity, {rev} AS rev, {price} AS price {extra} FROM items),
bench AS (SELECT store_id, max(quantity) AS mq, max(rev) AS mr FROM lst GROUP BY store_id),
tagged AS (
  SELECT l.*, CASE
    WHEN quantity = mq AND quantity > 0 THEN 'hot'
    WHEN rev = mr AND rev > 0 THEN 'revenue'
    WHEN price >= {PREMIUM_PRICE} AND quantity * 10 > mq * 3 THEN 'premium'
    WHEN quantity * 10 >= mq * 7 AND quantity < mq THEN 'rising' END AS tag_type
  FROM lst l JOIN bench b USING (store_id))
SELECT store_id, item_name, quantity {', net_sales, avg_price' if with_rev else ''}, tag_type,
       CASE tag_type WHEN 'hot' THEN 'Hot Seller' WHEN 'revenue' THEN 'High Revenue Driver'
                     WHEN 'premium' THEN 'Premium Performer' WHEN 'rising' THEN 'Rising Star' END AS tag_label
FROM tagged""")


def _flat_tag(df: DataFrame) -> DataFrame:
    return df.withColumn("tag_type", F.col("performance_tag.type")) \
             .withColumn("tag_label", F.col("performance_tag.label")).drop("performance_tag")


@query("performance_tags", _tag_sql(True))
def q_performance_tags(spark, sf_dir):
    items = agg.item_list(_sales(spark, sf_dir), STORE, with_revenue=True).drop("qty_sum")
    return _flat_tag(lab.performance_tags(items, STORE, premium_price=PREMIUM_PRICE))


@query("tags_quantity_only", _tag_sql(False))
def q_tags_quantity_only(spark, sf_dir):
    items = agg.item_list(_sales(spark, sf_dir), STORE, with_revenue=False).drop("qty_sum")
    return _flat_tag(lab.performance_tags(items, STORE, premium_price=PREMIUM_PRICE))


# ---------------------------------------------------------------- A6-A10
@query("totals", with_sales(f"""t AS (SELECT store_id, sum(net_sales) AS n, sum(discount_amount) AS d
                                      FROM sales GROUP BY store_id)
SELECT store_id, {money_sql('n')} AS total_revenue, {money_sql('d')} AS total_discount,
       {pct_sql('d', 'n + d')} AS discount_pct FROM t"""))
def q_totals(spark, sf_dir):
    return agg.group_totals(_sales(spark, sf_dir), STORE)


@query("category_share", with_sales(CATS_SQL + f""",
t AS (SELECT store_id, sum(net_sales) AS total FROM sales GROUP BY store_id)
SELECT c.store_id, category, {money_sql('n')} AS net_sales, {pct_sql('n', 'total')} AS share_pct
FROM cats c JOIN t USING (store_id)"""))
def q_category_share(spark, sf_dir):
    return agg.category_share(_sales(spark, sf_dir), STORE)


@query("discount_share", with_sales(f"""t AS (SELECT store_id, sum(net_sales) AS n, sum(discount_amount) AS d
                                      FROM sales GROUP BY store_id)
SELECT store_id, {money_sql('d')} AS total_discount, {pct_sql('d', 'n + d')} AS discount_pct,
       'Total discounts: ' || {money_text_sql('d')} || ' (' || printf('%.1f', {pct_sql('d', 'n + d')})
       || '% of gross sales)' AS text
FROM t WHERE d > 0"""))
def q_discount_share(spark, sf_dir):
    from ..functions.text import fixed_text, money_text
    s = agg.group_totals(_sales(spark, sf_dir), STORE).filter(F.col("total_discount") > 0)
    return s.select(
        *STORE, "total_discount", "discount_pct",
        F.concat(F.lit("Total discounts: "), money_text("total_discount"), F.lit(" ("), fixed_text(F.col("discount_pct"), 1),
                 F.lit("% of gross sales)")).alias("text"))


@query("date_range", with_sales("""r AS (SELECT store_id, min(date) AS a, max(date) AS b FROM sales
                                     WHERE date IS NOT NULL GROUP BY store_id)
SELECT store_id, strftime(a, '%b %d, %Y') AS start, strftime(b, '%b %d, %Y') AS "end" FROM r"""))
def q_date_range(spark, sf_dir):
    return agg.date_range(_sales(spark, sf_dir), STORE)


def _long_date_sql(d: str) -> str:
    return f"monthname({d}) || ' ' || CAST(day({d}) AS VARCHAR) || ', ' || CAST(year({d}) AS VARCHAR)"


@query("data_period", with_sales(f"""r AS (SELECT store_id, min(date) AS a, max(date) AS b FROM sales
                                     WHERE date IS NOT NULL GROUP BY store_id)
SELECT store_id, CASE WHEN a = b THEN {_long_date_sql('a')}
                      ELSE {_long_date_sql('a')} || ' – ' || {_long_date_sql('b')} END AS data_period FROM r"""))
def q_data_period(spark, sf_dir):
    return agg.data_period(_sales(spark, sf_dir), STORE)


# ---------------------------------------------------------------- A11-A16, O4
def _argmax_sql(measure: str, cols: str, where: str = "") -> str:
    return with_sales(f"""r AS (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {measure} DESC, {ROW_ORDER}) AS rk
  FROM sales WHERE {measure} IS NOT NULL {where})
SELECT store_id, {cols} FROM r WHERE rk = 1""")


@query("best_seller", _argmax_sql("quantity", f"item_name, {int_sql('quantity')} AS quantity"))
def q_best_seller(spark, sf_dir):
    return ins.best_seller(_sales(spark, sf_dir), STORE)


@query("top_revenue_row", _argmax_sql("net_sales", f"item_name, {money_sql('net_sales')} AS net_sales"))
def q_top_revenue_row(spark, sf_dir):
    return ins.top_revenue_row(_sales(spark, sf_dir), STORE)


@query("top_premium_row", _argmax_sql(
    "quantity", f"item_name, {money_sql('avg_price')} AS avg_price, {int_sql('quantity')} AS quantity",
    where=f"AND avg_price > {PREMIUM_PRICE}"))
def q_top_premium_row(spark, sf_dir):
    return ins.top_premium_row(_sales(spark, sf_dir), STORE, premium_price=PREMIUM_PRICE)


@query("top_revenue_category", with_sales(CATS_SQL + f""",
t AS (SELECT store_id, sum(net_sales) AS total FROM sales GROUP BY store_id),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS rk FROM cats)
SELECT r.store_id, category, {money_sql('n')} AS net_sales, {pct_sql('n', 'total')} AS share_pct
FROM r JOIN t USING (store_id) WHERE rk = 1"""))
def q_top_revenue_category(spark, sf_dir):
    return ins.top_revenue_category(_sales(spark, sf_dir), STORE)


@query("month_category", with_sales(f"""m AS (
  SELECT store_id, monthname(date) AS month, category, sum(quantity) AS q FROM sales
  WHERE date IS NOT NULL AND category IS NOT NULL GROUP BY store_id, monthname(date), category)
SELECT store_id, month, category, {int_sql('q')} AS quantity FROM m"""))
def q_month_category(spark, sf_dir):
    return agg.month_category(_sales(spark, sf_dir), STORE)


MONTH_TOP_SQL = """m AS (
  SELECT store_id, monthname(date) AS month, category, sum(quantity) AS q FROM sales
  WHERE date IS NOT NULL AND category IS NOT NULL GROUP BY store_id, monthname(date), category),
mt AS (SELECT *, row_number() OVER (PARTITION BY store_id, month ORDER BY q DESC, category) AS rk FROM m),
mr AS (SELECT store_id, month, category,
              row_number() OVER (PARTITION BY store_id ORDER BY month) AS month_rank
       FROM mt WHERE rk = 1)"""


@query("insight_no_data", with_sales(f"""b AS (
  SELECT l_orderkey AS order_id, item_name, quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY quantity DESC, {ROW_ORDER}) AS rk FROM sales)
SELECT o_orderkey AS order_id, 1 AS seq, CASE WHEN item_name IS NULL THEN 'info' ELSE 'bestseller' END AS type,
       CASE WHEN item_name IS NULL THEN 'No data available for insights'
            ELSE item_name || ' is the top seller with ' || CAST(trunc(quantity) AS BIGINT) || ' units sold' END AS text
FROM orders LEFT JOIN b ON order_id = o_orderkey AND rk = 1"""))
def q_insight_no_data(spark, sf_dir):
    """A22 over every order as an upload, with or without rows: the first insight of each."""
    sales = sales_columns(stored_lean(sales_rows(spark, sf_dir), "sales-rows")).withColumn("order_id", F.col("row_key.l_orderkey"))
    uploads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    found = ins.insights(sales, ["order_id"], PREMIUM_PRICE, uploads=uploads)
    return found.filter("seq = 1").join(uploads, "order_id", "left_semi")


@query("monthly_trend", with_sales(MONTH_TOP_SQL + """
SELECT store_id, CAST(month_rank AS INTEGER) AS month_rank, month, category,
       'Higher ' || lower(category) || ' sales in ' || month AS text
FROM mr WHERE month_rank <= 2"""))
def q_monthly_trend(spark, sf_dir):
    return ins.monthly_trend(_sales(spark, sf_dir), STORE, max_months=2)


INSIGHTS_CTES = CATS_SQL + f""",
tot AS (SELECT store_id, sum(net_sales) AS n, sum(discount_amount) AS d FROM sales GROUP BY store_id),
best AS (SELECT store_id, item_name, quantity, row_number() OVER (PARTITION BY store_id ORDER BY quantity DESC, {ROW_ORDER}) AS rk
         FROM sales WHERE quantity IS NOT NULL),
toprev AS (SELECT store_id, item_name, net_sales, row_number() OVER (PARTITION BY store_id ORDER BY net_sales DESC, {ROW_ORDER}) AS rk
           FROM sales WHERE net_sales IS NOT NULL),
prem AS (SELECT store_id, item_name, avg_price, quantity,
                row_number() OVER (PARTITION BY store_id ORDER BY quantity DESC, {ROW_ORDER}) AS rk
         FROM sales WHERE avg_price > {PREMIUM_PRICE} AND quantity IS NOT NULL),
topcat AS (SELECT store_id, category, n AS cat_n,
                  row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS rk FROM cats),
u AS (
  SELECT store_id, 1 AS ord, 'bestseller' AS type,
         item_name || ' is the top seller with ' || CAST({int_sql('quantity')} AS VARCHAR) || ' units sold' AS text
  FROM best WHERE rk = 1
  UNION ALL
  SELECT c.store_id, 2, 'revenue', category || ' drives ' || printf('%.0f', {pct_sql('cat_n', 'n')})
         || '% of total revenue (' || {money_text_sql('cat_n')} || ')'
  FROM topcat c JOIN tot t USING (store_id) WHERE c.rk = 1 AND t.n > 0
  UNION ALL
  SELECT r.store_id, 3, 'top_revenue', item_name || ' generates the most revenue at ' || {money_text_sql('net_sales')}
  FROM toprev r JOIN tot t USING (store_id) WHERE r.rk = 1 AND t.n > 0
  UNION ALL
  SELECT store_id, 4, 'discount', 'Total discounts: ' || {money_text_sql('d')} || ' ('
         || printf('%.1f', {pct_sql('d', 'n + d')}) || '% of gross sales)'
  FROM tot WHERE n > 0 AND d > 0
  UNION ALL
  SELECT p.store_id, 5, 'premium', item_name || ' is the top premium item ($'
         || CAST(CAST(round(avg_price, 2) AS DECIMAL(38,2)) AS VARCHAR) || ' avg) with '
         || CAST({int_sql('quantity')} AS VARCHAR) || ' sales'
  FROM prem p JOIN tot t USING (store_id) WHERE p.rk = 1 AND t.n > 0),
ins AS (SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY ord) AS INTEGER) AS seq, type, text
        FROM u)"""

INSIGHTS_SQL = with_sales(INSIGHTS_CTES + "\nSELECT * FROM ins")


@query("insights", INSIGHTS_SQL)
def q_insights(spark, sf_dir):
    return ins.insights(_sales_table(spark, sf_dir), STORE, premium_price=PREMIUM_PRICE)


# ---------------------------------------------------------------- J1-J4, W4-W8, U2
from ..operators import compare as cmp  # noqa: E402

UP_ITEMS_SQL = """items AS (SELECT store_id, period, item_name, sum(quantity) AS q
                  FROM sales GROUP BY store_id, period, item_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id, period ORDER BY q DESC, item_name) AS rk FROM items)"""

LAG_PAIRS_SQL = """ups AS (SELECT DISTINCT store_id, period FROM sales),
pairs AS (SELECT store_id, prev_upload, curr_upload FROM (
            SELECT store_id, period AS curr_upload,
                   lag(period) OVER (PARTITION BY store_id ORDER BY period) AS prev_upload FROM ups)
          WHERE prev_upload IS NOT NULL)"""


def _panel_old_sql(pairs_sql: str) -> str:
    return with_sales(UP_ITEMS_SQL + ",\n" + pairs_sql + f""",
prev_top AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, r.rk AS prev_rank, {int_sql('r.q')} AS prev_qty
             FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.prev_upload WHERE r.rk <= 5),
curr_all AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, r.rk AS curr_rank, {int_sql('r.q')} AS curr_qty
             FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.curr_upload)
SELECT t.store_id, t.prev_upload, t.curr_upload, CAST(t.prev_rank AS INTEGER) AS prev_rank, t.item_name, t.prev_qty,
       coalesce(c.curr_qty, 0) AS curr_qty,
       CASE WHEN t.prev_qty = 0 THEN NULL
            ELSE (CAST(coalesce(c.curr_qty, 0) AS DOUBLE) - CAST(t.prev_qty AS DOUBLE)) / CAST(t.prev_qty AS DOUBLE) * 100 END AS pct_change,
       CASE WHEN c.curr_rank <= 5 THEN 'Still Top 5' ELSE 'Dropped from Top 5' END AS status
FROM prev_top t LEFT JOIN curr_all c
  ON c.store_id = t.store_id AND c.prev_upload = t.prev_upload AND c.curr_upload = t.curr_upload
 AND c.item_name = t.item_name""")


@query("compare_panels_old", _panel_old_sql(LAG_PAIRS_SQL))
def q_compare_panels_old(spark, sf_dir):
    s = _sales_table(spark, sf_dir)
    pairs = cmp.successive_pairs(s, STORE, "period")
    return cmp.top_panels(s, pairs, STORE, "period", 5)[0]


@query("status_class", "SELECT store_id, prev_upload, curr_upload, prev_rank, item_name, status,\n"
       "  CASE WHEN status IS NULL THEN 'status-neutral' WHEN lower(status) LIKE '%still%' THEN 'status-good'\n"
       "       WHEN lower(status) LIKE '%dropped%' THEN 'status-bad'\n"
       "       WHEN lower(status) LIKE '%entered%' OR lower(status) LIKE '%new%' THEN 'status-info'\n"
       "       ELSE 'status-neutral' END AS status_class,\n"
       "  CASE WHEN pct_change IS NULL OR isnan(pct_change) THEN '—'\n"
       "       ELSE (CASE WHEN pct_change > 0 THEN '+' ELSE '' END) || printf('%.1f', pct_change) || '%' END AS pct_text,\n"
       "  CASE WHEN pct_change > 0 THEN 'percent-good' WHEN pct_change < 0 THEN 'percent-bad'\n"
       "       ELSE 'percent-neutral' END AS pct_class\n"
       "FROM (" + _panel_old_sql(LAG_PAIRS_SQL) + ") panel")
def q_status_class(spark, sf_dir):
    """W6 consumer + F11/F13: the UI classes of the previous-period panel."""
    from ..functions import text as tx
    panel = q_compare_panels_old(spark, sf_dir)
    return panel.select(
        "store_id", "prev_upload", "curr_upload", "prev_rank", "item_name", "status",
        tx.status_class("status").alias("status_class"),
        tx.signed_pct_text("pct_change").alias("pct_text"),
        tx.sign_class("pct_change", "percent-good", "percent-bad", "percent-neutral").alias("pct_class"))


@query("compare_panels_new", with_sales(UP_ITEMS_SQL + ",\n" + LAG_PAIRS_SQL + f"""
SELECT p.store_id, p.prev_upload, p.curr_upload, CAST(r.rk AS INTEGER) AS curr_rank, r.item_name,
       {int_sql('r.q')} AS curr_qty
FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.curr_upload WHERE r.rk <= 5"""))
def q_compare_panels_new(spark, sf_dir):
    s = _sales_table(spark, sf_dir)
    pairs = cmp.successive_pairs(s, STORE, "period")
    return cmp.top_panels(s, pairs, STORE, "period", 5)[1]


@query("compare_successive_periods", _panel_old_sql(LAG_PAIRS_SQL))
def q_compare_successive_periods(spark, sf_dir):
    s = _sales_table(spark, sf_dir)
    pairs = cmp.successive_pairs(s, STORE, "period")
    return cmp.top_panels(s, pairs, STORE, "period", 5)[0]


@query("full_comparison", with_sales(UP_ITEMS_SQL + ",\n" + LAG_PAIRS_SQL + f""",
pv AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, r.rk, {int_sql('r.q')} AS qty
       FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.prev_upload),
cu AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, r.rk, {int_sql('r.q')} AS qty
       FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.curr_upload),
j AS (SELECT coalesce(pv.store_id, cu.store_id) AS store_id, coalesce(pv.prev_upload, cu.prev_upload) AS prev_upload,
             coalesce(pv.curr_upload, cu.curr_upload) AS curr_upload, coalesce(pv.item_name, cu.item_name) AS item_name,
             coalesce(pv.qty, 0) AS previous, coalesce(cu.qty, 0) AS current,
             CAST(pv.rk AS INTEGER) AS prev_rank, CAST(cu.rk AS INTEGER) AS curr_rank
      FROM pv FULL OUTER JOIN cu ON pv.store_id = cu.store_id AND pv.item_name = cu.item_name
       AND pv.prev_upload = cu.prev_upload AND pv.curr_upload = cu.curr_upload)
SELECT *, CASE WHEN previous = 0 THEN NULL
               ELSE (CAST(current AS DOUBLE) - CAST(previous AS DOUBLE)) / CAST(previous AS DOUBLE) * 100 END AS percent_change,
       prev_rank - curr_rank AS rank_change
FROM j"""))
def q_full_comparison(spark, sf_dir):
    s = _sales_table(spark, sf_dir)
    pairs = cmp.successive_pairs(s, STORE, "period")
    return cmp.full_comparison(s, pairs, STORE, "period")


def _set_sql(kind: str) -> str:
    base = with_sales(UP_ITEMS_SQL + ",\n" + LAG_PAIRS_SQL + """,
pt AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, CAST(r.rk AS INTEGER) AS rank
       FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.prev_upload WHERE r.rk <= 5),
ct AS (SELECT p.store_id, p.prev_upload, p.curr_upload, r.item_name, CAST(r.rk AS INTEGER) AS rank
       FROM pairs p JOIN ranked r ON r.store_id = p.store_id AND r.period = p.curr_upload WHERE r.rk <= 5)
""")
    a, b, neg = {"kept": ("pt", "ct", ""), "dropped": ("pt", "ct", "NOT"),
                 "entered": ("ct", "pt", "NOT")}[kind]
    return base + f"""SELECT * FROM {a} x WHERE {neg} EXISTS (
  SELECT 1 FROM {b} y WHERE y.store_id = x.store_id AND y.prev_upload = x.prev_upload AND y.item_name = x.item_name)"""


def _set_query(kind: str):
    def fn(spark, sf_dir):
        s = _sales_table(spark, sf_dir)
        pairs = cmp.successive_pairs(s, STORE, "period")
        return cmp.top_sets(s, pairs, STORE, "period", 5)[kind]
    return fn


for _kind in ("kept", "dropped", "entered"):
    query(f"{_kind}_items", _set_sql(_kind))(_set_query(_kind))


# ---------------------------------------------------------------- X13-X15, T3, T4
from ..operators import events as ev  # noqa: E402
from ..sources.tables import table  # noqa: E402

# How driver events stand in for progress events of a reply stream.
EVENT_STATUS = {"view": "connecting", "click": "generating", "purchase": "streaming",
                "signup": "processing"}
EVENT_MESSAGE = {"connecting": ev.TEXT_CONNECTING, "generating": ev.TEXT_GENERATING,
                 "processing": ev.TEXT_PROCESSING}
FRAMES_PER_CHUNK = 4


def progress_events(spark, sf_dir) -> DataFrame:
    """One progress event per driver event: request = user, sequence = event id."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    status = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])[F.col("event_type")]
    message = F.create_map(*[F.lit(x) for kv in EVENT_MESSAGE.items() for x in kv])[status]
    return e.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts",
        status.alias("status"), message.alias("message"),
        F.when(status == "streaming", F.floor(F.col("value") * 100).cast("bigint")).alias("partial"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Error: upstream "), F.col("props"))).alias("error"))


PROGRESS_SQL = """pe AS (
  SELECT user_id AS request_id, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'connecting' WHEN 'click' THEN 'generating'
                         WHEN 'purchase' THEN 'streaming' WHEN 'signup' THEN 'processing' END AS status,
         CASE event_type WHEN 'view' THEN 'Connecting to AI...' WHEN 'click' THEN 'Generating marketing content...'
                         WHEN 'signup' THEN 'Processing response...' END AS message,
         CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) END AS partial,
         CASE WHEN event_type = 'error' THEN 'Error: upstream ' || props END AS error
  FROM events)"""


@query("event_frames", f"WITH {PROGRESS_SQL} SELECT request_id, seq, status, message, partial, error FROM pe")
def q_event_frames(spark, sf_dir):
    pe = progress_events(spark, sf_dir)
    payload = F.to_json(F.struct("status", "message", "partial", "error", "request_id", "seq"))
    # a network chunk carries up to FRAMES_PER_CHUNK consecutive frames of one request
    framed = pe.select("request_id", F.floor(F.col("seq") / FRAMES_PER_CHUNK).alias("chunk_no"),
                       "seq", ev.frame(payload).alias("frame"))
    chunks = framed.groupBy("request_id", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))),
                                 lambda x: x["frame"]), "").alias("chunk"))
    out = ev.decode_frames(chunks, "chunk", keep=["chunk_no"])
    return out.select("request_id", "seq", "status", "message", "partial", "error")


PROGRESS_TEXT_SQL = """CASE WHEN error IS NOT NULL THEN error
  WHEN status = 'connecting' THEN 'Connecting to AI...'
  WHEN status = 'generating' THEN 'Generating marketing content...'
  WHEN status = 'streaming' THEN 'Generating content... (' || CAST(partial AS VARCHAR) || ' chars)'
  WHEN status = 'processing' THEN 'Processing response...'
  WHEN status = 'complete' THEN '' END"""


@query("progress_text", f"WITH {PROGRESS_SQL} SELECT request_id, seq, {PROGRESS_TEXT_SQL} AS progress_text FROM pe")
def q_progress_text(spark, sf_dir):
    pe = progress_events(spark, sf_dir)
    return pe.select("request_id", "seq", ev.progress_text("status", "partial", "error").alias("progress_text"))


@query("latest_status", f"""WITH {PROGRESS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, seq DESC) AS rk,
             count(*) OVER (PARTITION BY request_id) AS n_events FROM pe)
SELECT request_id, n_events, seq, status, partial, error, {PROGRESS_TEXT_SQL} AS progress_text FROM r WHERE rk = 1""")
def q_latest_status(spark, sf_dir):
    pe = progress_events(spark, sf_dir).withColumn(
        "progress_text", ev.progress_text("status", "partial", "error"))
    return ev.latest_status(pe, ["request_id"], ["ts", "seq"],
                            ["seq", "status", "partial", "error", "progress_text"])


@query("reply_progress", """SELECT conv_id, turn, role,
  sum(CAST(length(text) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS partial
FROM conversations""")
def q_reply_progress(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return ev.running_length(c, ["conv_id"], ["turn"], "text").drop("text")


# Error texts the driver events stand in for.
ERROR_TEXTS = {"view": "Error code: 401 - authentication failed for this key",
               "click": "rate_limit_exceeded: too many requests",
               "purchase": "The model does not exist or you do not have access",
               "signup": "Connection error while calling the API"}


def _error_sql_case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ERROR_TEXTS.items()) \
        + " ELSE 'unexpected failure ' || props END"


def _err_case_sql(variant: str) -> str:
    m = "lower(message)"
    if variant == "stream":
        return f"""CASE WHEN contains({m}, 'authentication') OR contains({m}, 'api key') OR contains({m}, 'invalid_api_key')
            THEN ['authentication', '{ev.ERR_AUTH}']
          WHEN contains({m}, 'rate_limit') OR contains({m}, 'rate limit') THEN ['rate_limit', '{ev.ERR_RATE}']
          WHEN contains({m}, 'model') AND (contains({m}, 'not found') OR contains({m}, 'does not exist'))
            THEN ['model_not_found', 'Model ''' || model || ''' not found. Please check the model name.']
          WHEN contains({m}, 'connection') THEN ['connection', '{ev.ERR_CONN}']
          ELSE ['other', 'Error: ' || message] END"""
    if variant == "plain":
        return f"""CASE WHEN contains({m}, 'authentication') OR contains({m}, 'api key') THEN ['authentication', '{ev.ERR_AUTH_PLAIN}']
          WHEN contains({m}, 'rate_limit') THEN ['rate_limit', '{ev.ERR_RATE}']
          WHEN contains({m}, 'model') AND contains({m}, 'not found')
            THEN ['model_not_found', 'Model ''' || model || ''' not found. Please use a valid model name.']
          ELSE ['other', 'Error: ' || message] END"""
    return f"""CASE WHEN contains({m}, 'authentication') OR contains({m}, 'api key') THEN ['authentication', '{ev.ERR_AUTH_SERVER}']
          WHEN contains({m}, 'rate_limit') THEN ['rate_limit', '{ev.ERR_RATE_SERVER}']
          WHEN contains({m}, 'model') AND contains({m}, 'not found') THEN ['model_not_found', '{ev.ERR_MODEL_SERVER}']
          WHEN contains({m}, 'connection') THEN ['connection', '{ev.ERR_CONN}']
          ELSE ['other', 'Error: ' || message] END"""


@query("error_class", f"""WITH m AS (SELECT event_id, {_error_sql_case()} AS message,
                                    'model-' || CAST(user_id AS VARCHAR) AS model FROM events),
c AS (SELECT event_id, message, {_err_case_sql('stream')} AS s, {_err_case_sql('plain')} AS p,
             {_err_case_sql('server')} AS v FROM m)
SELECT event_id, message, s[1] AS stream_class, s[2] AS stream_message, p[1] AS plain_class,
       p[2] AS plain_message, v[1] AS server_class, v[2] AS server_message FROM c""")
def q_error_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    msg = F.coalesce(F.create_map(*[F.lit(x) for kv in ERROR_TEXTS.items() for x in kv])[F.col("event_type")],
                     F.concat(F.lit("unexpected failure "), F.col("props")))
    m = e.select("event_id", msg.alias("message"),
                 F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("model"))
    out = m.select("event_id", "message",
                   ev.error_class("message", "model", "stream").alias("s"),
                   ev.error_class("message", "model", "plain").alias("p"),
                   ev.error_class("message", "model", "server").alias("v"))
    return out.select("event_id", "message",
                      F.col("s.error_class").alias("stream_class"), F.col("s.user_message").alias("stream_message"),
                      F.col("p.error_class").alias("plain_class"), F.col("p.user_message").alias("plain_message"),
                      F.col("v.error_class").alias("server_class"), F.col("v.user_message").alias("server_message"))


# ---------------------------------------------------------------- F8-F13
from ..functions import text as tx  # noqa: E402


@query("currency_text", """SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(38,6)), 2) AS DOUBLE) AS acctbal,
  CASE WHEN round(CAST(c_acctbal AS DECIMAL(38,6)), 2) < 0
       THEN '-$' || format('{:,.2f}', abs(round(CAST(c_acctbal AS DECIMAL(38,6)), 2)))
       ELSE '$' || format('{:,.2f}', round(CAST(c_acctbal AS DECIMAL(38,6)), 2)) END AS currency_text,
  CASE WHEN c_acctbal > 0 THEN 'good' WHEN c_acctbal < 0 THEN 'bad' ELSE 'neutral' END AS balance_class
FROM customer""")
def q_currency_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.select("c_custkey", F.round(F.col("c_acctbal").cast("decimal(38,6)"), 2).cast("double").alias("acctbal"),
                    tx.currency_text("c_acctbal").alias("currency_text"),
                    tx.sign_class("c_acctbal").alias("balance_class"))


@query("quantity_fallback", """WITH q AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 0
              ELSE CAST(l_quantity AS BIGINT) END AS quantity,
         CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS total_sold
  FROM lineitem)
SELECT l_orderkey, l_linenumber, quantity, total_sold,
       coalesce(quantity, total_sold, 0) AS qty_py,
       coalesce(nullif(quantity, 0), nullif(total_sold, 0), 0) AS qty_js
FROM q""")
def q_quantity_fallback(spark, sf_dir):
    """F16 over every lineitem row: missing (return flag R) and zero (line
    status F) quantities fall back to a total that is missing for flag A."""
    from ..functions.coerce import fallback_quantity
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    q = li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("bigint"))
        .when(F.col("l_linestatus") == "F", F.lit(0).cast("bigint"))
        .otherwise(F.col("l_quantity").cast("bigint")).alias("quantity"),
        F.when(F.col("l_returnflag") == "A", F.lit(None).cast("bigint"))
        .otherwise(F.col("l_quantity").cast("bigint")).alias("total_sold"))
    return q.select("*", fallback_quantity("quantity", "total_sold").alias("qty_py"),
                    fallback_quantity("quantity", "total_sold", falsy=True).alias("qty_js"))


@query("percent_text", """WITH o AS (
  SELECT o_orderkey, o_custkey, o_totalprice,
         lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
p AS (SELECT *, CASE WHEN prev IS NULL OR prev = 0 THEN NULL ELSE (o_totalprice - prev) / prev * 100 END AS pct FROM o)
SELECT o_orderkey, o_custkey, pct AS pct_change,
       CASE WHEN pct IS NULL OR isnan(pct) THEN '—' ELSE (CASE WHEN pct > 0 THEN '+' ELSE '' END) || printf('%.1f', pct) || '%' END AS pct_text,
       CASE WHEN pct > 0 THEN 'percent-good' WHEN pct < 0 THEN 'percent-bad' ELSE 'percent-neutral' END AS pct_class,
       '$' || format('{:,.2f}', round(CAST(o_totalprice AS DECIMAL(38,6)), 2)) AS total_text
FROM p""")
def q_percent_text(spark, sf_dir):
    from pyspark.sql import Window

    from ..contracts import pct_change
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = o.withColumn("prev", F.lag("o_totalprice").over(w))
    p = p.withColumn("pct_change", pct_change("prev", "o_totalprice"))  # W5; one customer's orders to a window
    return p.select("o_orderkey", "o_custkey", "pct_change",
                    tx.signed_pct_text("pct_change").alias("pct_text"),
                    tx.sign_class("pct_change", "percent-good", "percent-bad", "percent-neutral").alias("pct_class"),
                    tx.money_text(F.col("o_totalprice").cast("decimal(38,6)")).alias("total_text"))


# ---------------------------------------------------------------- X4-X12 reply tables
from ..operators import replies as rp  # noqa: E402


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _doc_parts():
    """JSON pieces of a reply built from a part row (caption = part name …)."""
    ig = F.to_json(F.struct(F.col("p_name").alias("caption"),
                            F.array(F.concat(F.lit("#"), F.regexp_replace("p_brand", "#", "")),
                                    F.concat(F.lit("#"), F.lower("p_type"))).alias("hashtags")))
    tt = F.to_json(F.struct(F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string")).alias("caption"),
                            F.array(F.concat(F.lit("#"), F.lower("p_type"))).alias("hashtags")))
    ideas = F.to_json(F.array(F.struct(F.concat(F.lit("Feature "), "p_name").alias("text"),
                                       F.concat("p_brand", F.lit(" sells")).alias("reason"))))
    return ig, tt, ideas


def _doc(ig, tt, ideas):
    return F.concat(F.lit('{"instagram": '), ig, F.lit(', "tiktok": '), tt,
                    F.lit(', "promotion_ideas": '), ideas, F.lit("}"))


def _wrap(j):
    """Reply wrappers by row: fenced with tag, fenced plain, bare, unclosed fence."""
    k = F.col("p_partkey") % 4
    return (F.when(k == 0, F.concat(F.lit("Here you go:\n```json\n"), j, F.lit("\n```\nEnjoy")))
            .when(k == 1, F.concat(F.lit("```\n"), j, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("  "), j, F.lit("\n")))
            .otherwise(F.concat(F.lit("```json\n"), j)))


def _content_cols(parsed: str = "r"):
    c = F.col(f"{parsed}.content")
    return [F.col(f"{parsed}.layout").alias("layout"), F.col(f"{parsed}.error").alias("error"),
            c["instagram"]["caption"].alias("ig_caption"),
            F.array_join(c["instagram"]["hashtags"], " ").alias("ig_hashtags"),
            c["tiktok"]["caption"].alias("tt_caption"),
            F.array_join(c["tiktok"]["hashtags"], " ").alias("tt_hashtags"),
            tx.join_idea_texts(c["promotion_ideas"]).alias("idea_texts")]


EXPECTED_CURRENT_SQL = """SELECT p_partkey, 'current' AS layout, CAST(NULL AS VARCHAR) AS error, p_name AS ig_caption,
       '#' || replace(p_brand, '#', '') || ' #' || lower(p_type) AS ig_hashtags,
       p_name || ' size ' || CAST(p_size AS VARCHAR) AS tt_caption, '#' || lower(p_type) AS tt_hashtags,
       'Feature ' || p_name AS idea_texts FROM part"""


@query("reply_parse", EXPECTED_CURRENT_SQL)
def q_reply_parse(spark, sf_dir):
    p = _part(spark, sf_dir)
    text = _wrap(_doc(*_doc_parts()))
    return rp.parse_replies(p.select("p_partkey", text.alias("t")), "t", "r").select("p_partkey", *_content_cols())


def _json_string(j):
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(j, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))


@query("reply_double_encoded", EXPECTED_CURRENT_SQL)
def q_reply_double_encoded(spark, sf_dir):
    p = _part(spark, sf_dir)
    text = _wrap(_json_string(_doc(*_doc_parts())))
    return rp.parse_replies(p.select("p_partkey", text.alias("t")), "t", "r").select("p_partkey", *_content_cols())


@query("reply_nested_caption", EXPECTED_CURRENT_SQL)
def q_reply_nested_caption(spark, sf_dir):
    p = _part(spark, sf_dir)
    inner = _doc(*_doc_parts())
    outer = F.concat(F.lit('{"instagram": {"caption": '), _json_string(F.concat(F.lit(" "), inner)),
                     F.lit(', "hashtags": []}, "tiktok": {"caption": "", "hashtags": []}, "promotion_ideas": []}'))
    return rp.parse_replies(p.select("p_partkey", _wrap(outer).alias("t")), "t", "r") \
        .select("p_partkey", *_content_cols())


@query("reply_legacy", """WITH t AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size % 3 AS nc,
         list_slice(list_transform(range(1, 11), lambda i: '#' || lower(p_type) || CAST(i AS VARCHAR)), 1, p_size % 11) AS tags
  FROM part)
SELECT p_partkey, 'legacy' AS layout, CAST(NULL AS VARCHAR) AS error,
       CASE WHEN nc >= 1 THEN p_name ELSE 'Check out our delicious food!' END AS ig_caption,
       array_to_string(list_slice(tags, 1, 8), ' ') AS ig_hashtags,
       CASE WHEN nc >= 2 THEN p_name || ' video' WHEN nc = 1 THEN p_name ELSE 'This food is amazing!' END AS tt_caption,
       array_to_string(list_slice(tags, 1, 3), ' ') AS tt_hashtags,
       'Feature ' || p_name AS idea_texts
FROM t""")
def q_reply_legacy(spark, sf_dir):
    p = _part(spark, sf_dir)
    caps = F.slice(F.array(F.col("p_name"), F.concat("p_name", F.lit(" video"))), 1, F.col("p_size") % 3)
    tags = F.slice(F.transform(F.sequence(F.lit(1), F.lit(10)),
                               lambda i: F.concat(F.lit("#"), F.lower("p_type"), i.cast("string"))),
                   1, F.col("p_size") % 11)
    ideas = F.array(F.struct(F.concat(F.lit("Feature "), "p_name").alias("text"),
                             F.concat("p_brand", F.lit(" sells")).alias("reason")))
    doc = F.to_json(F.struct(caps.alias("captions"), tags.alias("hashtags"), ideas.alias("promotion_ideas")))
    return rp.parse_replies(p.select("p_partkey", _wrap(doc).alias("t")), "t", "r") \
        .select("p_partkey", *_content_cols())


VALIDATE_FAULTS = 12


@query("reply_validate", f"""SELECT p_partkey, CASE p_partkey % {VALIDATE_FAULTS}
    WHEN 0 THEN NULL WHEN 1 THEN '{rp.ERR_IG_OBJ}' WHEN 2 THEN '{rp.ERR_TT_OBJ}' WHEN 3 THEN '{rp.ERR_IG_KEYS}'
    WHEN 4 THEN '{rp.ERR_IG_CAP}' WHEN 5 THEN '{rp.ERR_IG_TAGS}' WHEN 6 THEN '{rp.ERR_TT_CAP}'
    WHEN 7 THEN 'tiktok caption contains embedded JSON instead of plain caption text'
    WHEN 8 THEN '{rp.ERR_IDEA_OBJ}' WHEN 9 THEN '{rp.ERR_IDEA_KEYS}' WHEN 10 THEN '{rp.ERR_LAYOUT}'
    ELSE '{rp.ERR_JSON}' END AS error,
  CASE WHEN p_partkey % {VALIDATE_FAULTS} = 0 THEN p_name END AS ig_caption
FROM part""")
def q_reply_validate(spark, sf_dir):
    p = _part(spark, sf_dir)
    ig, tt, ideas = _doc_parts()
    k = F.col("p_partkey") % VALIDATE_FAULTS
    name_json = F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2)
    ig_v = (F.when(k == 1, name_json)
            .when(k == 3, F.concat(F.lit('{"caption": '), name_json, F.lit("}")))
            .when(k == 4, F.concat(F.lit('{"caption": '), F.col("p_size").cast("string"), F.lit(', "hashtags": []}')))
            .when(k == 5, F.concat(F.lit('{"caption": '), name_json, F.lit(', "hashtags": "#x"}')))
            .otherwise(ig))
    tt_v = (F.when(k == 2, F.lit("[]"))
            .when(k == 6, F.concat(F.lit('{"caption": '), F.col("p_size").cast("string"), F.lit(', "hashtags": []}')))
            .when(k == 7, F.lit('{"caption": " {\\"instagram\\": 1}", "hashtags": []}'))
            .otherwise(tt))
    ideas_v = (F.when(k == 8, F.to_json(F.array("p_name")))
               .when(k == 9, F.to_json(F.array(F.struct(F.col("p_name").alias("text")))))
               .otherwise(ideas))
    doc = F.when(k == 10, F.concat(F.lit('{"instagram": '), ig, F.lit(', "tiktok": '), tt, F.lit("}"))) \
        .otherwise(_doc(ig_v, tt_v, ideas_v))
    text = F.when(k == 11, F.concat(F.lit("```json\n"), F.substring(doc, 1, 20))).otherwise(_wrap(doc))
    r = rp.parse_replies(p.select("p_partkey", text.alias("t")), "t", "r")
    return r.select("p_partkey", F.col("r.error").alias("error"),
                    F.col("r.content.instagram.caption").alias("ig_caption"))


API_FAULTS = 8


@query("reply_api_validate", f"""SELECT p_partkey, CASE p_partkey % {API_FAULTS}
    WHEN 0 THEN NULL WHEN 1 THEN {sq(rp.ERR_API_ACTIONS)} WHEN 2 THEN {sq(rp.ERR_API_ACTIONS)}
    WHEN 3 THEN {sq(rp.ERR_API_IG)} WHEN 4 THEN {sq(rp.ERR_API_TT)} WHEN 5 THEN 'Missing ''caption'' in instagram'
    WHEN 6 THEN 'Missing or invalid ''hashtags'' in tiktok' ELSE '{rp.ERR_JSON}' END AS error,
  CASE WHEN p_partkey % {API_FAULTS} = 0 THEN 2 END AS n_actions,
  CASE WHEN p_partkey % {API_FAULTS} = 0 THEN p_name END AS ig_caption
FROM part""")
def q_reply_api_validate(spark, sf_dir):
    p = _part(spark, sf_dir)
    ig, tt, _ = _doc_parts()
    k = F.col("p_partkey") % API_FAULTS
    acts = F.to_json(F.array(F.concat(F.lit("Promote "), "p_name"), F.concat(F.lit("Bundle "), "p_type")))
    acts_v = F.when(k == 2, F.lit('"do it"')).otherwise(acts)
    ig_v = F.when(k == 5, F.lit('{"hashtags": []}')).otherwise(ig)
    tt_v = F.when(k == 4, F.lit('"tiktok"')).when(k == 6, F.lit('{"caption": "c", "hashtags": "#a"}')).otherwise(tt)
    parts = [F.when(k != 1, F.concat(F.lit('"recommended_actions": '), acts_v)),
             F.when(k != 3, F.concat(F.lit('"instagram": '), ig_v)),
             F.concat(F.lit('"tiktok": '), tt_v)]
    doc = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    text = F.when(k == 7, F.substring(doc, 1, 15)).otherwise(_wrap(doc))
    r = rp.parse_api_replies(p.select("p_partkey", text.alias("t")), "t", "r")
    return r.select("p_partkey", F.col("r.error").alias("error"),
                    F.size(F.col("r.content.recommended_actions")).alias("n_actions"),
                    F.col("r.content.instagram.caption").alias("ig_caption")) \
        .withColumn("n_actions", F.when(F.col("error").isNull(), F.col("n_actions")))


@query("platform_validate", """WITH t AS (SELECT p_partkey, p_name,
    ['instagram', 'tiktok', 'actions', 'facebook'][p_partkey % 4 + 1] AS platform, (p_partkey // 4) % 3 AS f FROM part)
SELECT p_partkey, platform,
  CASE WHEN platform = 'facebook' THEN 'platform must be one of: instagram, tiktok, actions'
       WHEN f = 1 AND platform = 'actions' THEN 'actions response must contain actions: [..] with 3 items'
       WHEN f = 1 THEN platform || ' response must contain caption (string) and hashtags (list)' END AS error,
  CASE WHEN platform IN ('instagram', 'tiktok') AND f <> 1 THEN p_name END AS caption,
  CASE WHEN platform = 'actions' AND f <> 1 THEN 3 END AS n_actions
FROM t""")
def q_platform_validate(spark, sf_dir):
    p = _part(spark, sf_dir)
    platform = F.element_at(F.array(*[F.lit(x) for x in ("instagram", "tiktok", "actions", "facebook")]),
                            (F.col("p_partkey") % 4 + 1).cast("int"))
    f = F.floor(F.col("p_partkey") / 4) % 3
    post_ok = F.concat(F.expr("substring(to_json(named_struct('caption', p_name)), 1, "
                              "length(to_json(named_struct('caption', p_name))) - 1)"),
                       F.lit(', "hashtags": ["#a", "#b"]}'))
    post_bad = F.concat(F.expr("substring(to_json(named_struct('caption', p_name)), 1, "
                               "length(to_json(named_struct('caption', p_name))) - 1)"),
                        F.lit(', "hashtags": "#a"}'))
    acts_ok = F.to_json(F.struct(F.array(F.lit("a1"), F.lit("a2"), F.col("p_name")).alias("actions")))
    acts_bad = F.to_json(F.struct(F.array(F.lit("a1"), F.col("p_name")).alias("actions")))
    is_acts = platform == "actions"
    body = F.when(f == 1, F.when(is_acts, acts_bad).otherwise(post_bad)) \
        .otherwise(F.when(is_acts, acts_ok).otherwise(post_ok))
    text = F.when(f == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    r = rp.parse_platform_replies(p.select("p_partkey", platform.alias("platform"), text.alias("t")),
                                  "platform", "t", "r")
    return r.select("p_partkey", "platform", F.col("r.error").alias("error"),
                    F.col("r.content.caption").alias("caption"),
                    F.when(F.col("r.error").isNull() & (F.col("platform") == "actions"),
                           F.size("r.content.actions")).alias("n_actions"))


# ---------------------------------------------------------------- S1-S9, P1-P8, F1-F4, Q1-Q3
from ..functions import coerce as co  # noqa: E402
from ..operators import quality as qa  # noqa: E402
from ..sources import exports as ex  # noqa: E402

EXPORT_HEADER = ("Sales Category,Item Name,Modifier,,{avg},{qty},Gross Sales,Discount Amount,Net Sales,Type,")
WIDE_LAYOUT = 30   # extra columns in front of the exports of every tenth store
NO_QTY_PERIOD = 1995


def export_lines(spark, sf_dir, avg="Avg. Price", qty_header="Item Qty", path=None) -> DataFrame:
    """Every lineitem row written as a line of its (supplier, year) export.

    Cells carry the quirks of real exports: trailing commas, a blank header
    column, quoted commas and quoted newlines, an inch mark inside a plain cell,
    NA words, blank names, numbers with thousands separators or junk, Type values, short
    rows, stray blank lines.  By store: rows wider than the
    header, an export of 40 columns, and a year without a quantity column.
    The lines are written once, as exports lie in files: the ingest scans them more than
    once.  Positions: header first, then rows; block = order key / 1024.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey)
    period, store = F.year("l_shipdate"), F.col("l_suppkey")
    upload = F.concat(F.lit("store="), store.cast("string"), F.lit("/period="), period.cast("string"))
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = (gross * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    net = (gross - disc).cast("decimal(18,4)")
    from ..sources.tables import unit_price
    qty = F.col("l_quantity").cast("int").cast("string")
    ln, size = F.col("l_linenumber"), F.col("p_size")
    item = (F.when((ln == 1) & (size % 5 == 0), F.lit("None"))
            .when(size % 13 == 0, F.lit("  "))
            .when(size > 45, F.concat(F.lit('"'), "p_name", F.lit(', large"')))
            .when(size == 7, F.concat(F.lit('"'), "p_name", F.lit('\nspecial"')))
            .when(size == 9, F.concat("p_name", F.lit(' 12"')))
            .when(size % 11 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
            .otherwise(F.col("p_name")))
    qty_text = (F.when(ln == 3, F.concat(F.lit('"1,'), F.lpad(qty, 3, "0"), F.lit('"')))
                .when(ln == 5, F.concat(F.lit(" "), qty, F.lit(" ")))
                .when(ln == 6, F.concat(qty, F.lit("d")))
                .otherwise(qty))
    type_text = F.when(F.col("l_returnflag") == "R", F.lit("modifier")) \
        .when(size == 3, F.lit("menuitem")).when(size != 17, F.lit("menuItem"))   # size 17: a short row
    many = store % 10 == 5
    line = F.concat_ws(",", F.when(many, F.lit(",".join("x" * WIDE_LAYOUT))), "p_type", item, F.lit(""), F.lit(""),
                       unit_price("_gross", "_qty").cast("string"), qty_text,
                       gross.cast("string"), disc.cast("string"), net.cast("string"), type_text)
    line = F.concat(line, F.when((size == 50) & (store % 10 == 3), F.lit(",x")).otherwise(F.lit("")),
                    F.when(ln == 2, F.lit(",,")).otherwise(F.lit(",")))
    rows = j.withColumn("_gross", gross).withColumn("_qty", F.col("l_quantity").cast("decimal(18,4)")) \
        .select(upload.alias("upload_id"), F.floor(F.col("l_orderkey") / 1024).cast("bigint").alias("block"),
                "l_orderkey", "l_linenumber", "l_partkey",
                F.when(ln == 4, F.array(line, F.lit("   ,,"))).otherwise(F.array(line)).alias("_ls"))
    # a quoted newline splits the text into two physical lines, which keep their order
    data = rows.select("upload_id", "block", "l_orderkey", "l_linenumber", "l_partkey",
                       F.posexplode(F.split(F.array_join("_ls", "\n"), "\n")).alias("sub", "line"))
    head = lambda q: EXPORT_HEADER.format(avg=avg, qty=q)
    no_qty = (store % 10 == 7) & (F.col("_p") == NO_QTY_PERIOD)
    titles = F.concat(F.when(many, F.lit("".join(f"Extra {i}," for i in range(WIDE_LAYOUT)))).otherwise(F.lit("")),
                      F.when(no_qty, F.lit(head("Pieces"))).otherwise(F.lit(head(qty_header))))
    header = j.select(upload.alias("upload_id"), store, period.alias("_p")).distinct().select(
        "upload_id", F.lit(-1).cast("bigint").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"), ("sub", "int"))], titles.alias("line"))
    every = header.unionByName(data).withColumn("off", F.monotonically_increasing_id())
    path = path or scratch_path(spark, "export-lines")
    write_lean(every, path)
    return spark.read.parquet(path).select("upload_id", F.struct("block", "off").alias("pos"), "line", "l_orderkey", "l_linenumber", "l_partkey", "sub")


def _keyed_sales(spark, sf_dir, variant=ex.BACKEND, **titles) -> DataFrame:
    """Ingested rows with the keys of the rows they were written from; the exports go once they are ingested."""
    path = scratch_path(spark, "export-lines")
    lines = export_lines(spark, sf_dir, path=path, **titles)
    keys = stored_lean(lines.filter(F.col("sub") == 0).select("upload_id", F.col("pos").alias("row_pos"), "l_orderkey", "l_linenumber", "l_partkey"), "export-keys")
    sales = ex.ingest_lines(lines, variant).sales
    published.delete_path(spark, path)
    s = sales.join(keys, ["upload_id", "row_pos"])
    return s.select(
        F.regexp_extract("upload_id", r"store=(\d+)", 1).cast("bigint").alias("store_id"),
        F.regexp_extract("upload_id", r"period=(\d+)", 1).cast("int").alias("period"),
        "l_orderkey", "l_linenumber", "l_partkey", "category", "item_name",
        F.col("quantity").cast("double").alias("quantity"), _money_out("net_sales").alias("net_sales"))


EXPORT_EXPECT_SQL = f"""x AS (
  SELECT l_suppkey AS store_id, CAST(year(l_shipdate) AS INTEGER) AS period, l_orderkey, l_linenumber, l_partkey,
         p_type AS category,
         CASE WHEN p_size > 45 THEN p_name || ', large' WHEN p_size = 7 THEN p_name || chr(10) || 'special'
              WHEN p_size = 9 THEN p_name || ' 12"' ELSE p_name END AS item_name,
         CASE WHEN l_linenumber IN (3, 6) THEN 0.0 ELSE l_quantity END AS quantity,
         CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              - CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)), 2) AS DOUBLE) AS net_sales,
         (l_linenumber = 1 AND p_size % 5 = 0) OR p_size % 13 = 0 AS blank_name,
         l_returnflag = 'R' OR p_size IN (3, 17) AS wrong_type,
         l_linenumber IN (3, 6) AS zeroed, p_size = 50 AND l_suppkey % 10 = 3 AS wide,
         l_suppkey % 10 = 7 AND year(l_shipdate) = {NO_QTY_PERIOD} AS no_qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _accepted_sql(kept: str) -> str:
    """Uploads that are not rejected."""
    return (f"ok AS (SELECT store_id, period FROM x GROUP BY store_id, period HAVING NOT bool_or(wide) AND NOT bool_or(no_qty)"
            f" AND count(*) FILTER (WHERE {kept}) > 0)")


@query("ingest_csv_lines", f"""WITH {EXPORT_EXPECT_SQL},
{_accepted_sql("NOT blank_name AND NOT wrong_type")}
SELECT store_id, period, l_orderkey, l_linenumber, l_partkey, category, item_name, quantity, net_sales
FROM x JOIN ok USING (store_id, period) WHERE NOT blank_name AND NOT wrong_type""")
def q_ingest_csv_lines(spark, sf_dir):
    return _keyed_sales(spark, sf_dir)


@query("ingest_api_lines", f"""WITH {EXPORT_EXPECT_SQL},
{_accepted_sql("NOT blank_name")}
SELECT store_id, period, l_orderkey, l_linenumber, l_partkey, category, item_name, quantity, net_sales
FROM x JOIN ok USING (store_id, period) WHERE NOT blank_name""")
def q_ingest_api_lines(spark, sf_dir):
    """The serverless variant: fewer aliases, no ``Type`` filter."""
    return _keyed_sales(spark, sf_dir, ex.SERVERLESS, avg="Avg Price", qty_header="Quantity")


@query("ingest_rejects", f"""WITH {EXPORT_EXPECT_SQL}
SELECT 'store=' || CAST(store_id AS VARCHAR) || '/period=' || CAST(period AS VARCHAR) AS upload_id,
       CASE WHEN bool_or(wide) THEN {sq(ex.ERR_WIDE)}
            WHEN count(*) FILTER (WHERE NOT blank_name AND NOT wrong_type) = 0 THEN {sq(ex.ERR_NO_ITEMS)}
            ELSE {sq(ex.ERR_NO_QTY + "['category', 'item_name', 'Modifier', 'avg_price', 'Pieces', 'gross_sales', 'discount_amount', 'net_sales', 'Type']" + ex.ERR_NO_QTY_TAIL)}
       END AS error
FROM x GROUP BY store_id, period
HAVING bool_or(wide) OR bool_or(no_qty) OR count(*) FILTER (WHERE NOT blank_name AND NOT wrong_type) = 0""")
def q_ingest_rejects(spark, sf_dir):
    return ex.ingest_lines(export_lines(spark, sf_dir)).rejects


@query("quality_report", f"""WITH {EXPORT_EXPECT_SQL}
SELECT 'store=' || CAST(store_id AS VARCHAR) || '/period=' || CAST(period AS VARCHAR) AS upload_id, 'menu' AS layout,
       CAST(0 AS BIGINT) AS repeated_headers,
       count(*) AS data_rows, count(*) FILTER (WHERE wrong_type) AS dropped_type,
       count(*) FILTER (WHERE NOT wrong_type AND blank_name) AS dropped_blank_name,
       CAST(0 AS BIGINT) AS dropped_marker,
       count(*) FILTER (WHERE NOT wrong_type AND NOT blank_name) AS kept_rows,
       count(*) FILTER (WHERE NOT wrong_type AND NOT blank_name AND zeroed AND NOT no_qty) AS zeroed_numeric_rows,
       CAST(0 AS BIGINT) AS unparsed_dates,
       count(*) FILTER (WHERE wide) AS wide_rows
FROM x GROUP BY store_id, period""")
def q_quality_report(spark, sf_dir):
    return ex.ingest_lines(export_lines(spark, sf_dir)).quality


HEADER_CANDIDATES = ["Sales Category", "Item Name", "Item, Open Item", "Item Qty", "Qty Sold", "Quantity",
                     "Avg Price", "Avg. Price", "Gross Sales", "Discount Amount", "Net Sales", "quantity_sold",
                     "Date", "item_name", "Type", "Modifier"]


def _alias_case_sql(aliases: dict[str, str], h: str) -> str:
    return f"CASE lower(trim({h})) " + " ".join(f"WHEN {sq(k)} THEN {sq(v)}" for k, v in aliases.items()) \
        + f" ELSE {h} END"


@query("header_alias", f"""WITH h AS (
  SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(base) WHEN p_size % 3 = 1 THEN '  ' || base || ' '
                         ELSE base END AS header
  FROM (SELECT p_partkey, p_size,
               CASE WHEN p_partkey % {len(HEADER_CANDIDATES) + 1} = {len(HEADER_CANDIDATES)} THEN p_brand
                    ELSE [{', '.join(sq(c) for c in HEADER_CANDIDATES)}][p_partkey % {len(HEADER_CANDIDATES) + 1} + 1]
               END AS base FROM part))
SELECT p_partkey, header, {_alias_case_sql(ex.HEADER_ALIASES, 'header')} AS canonical,
       {_alias_case_sql(ex.HEADER_ALIASES_API, 'header')} AS api_canonical FROM h""")
def q_header_alias(spark, sf_dir):
    p = _part(spark, sf_dir)
    n = len(HEADER_CANDIDATES) + 1
    k = (F.col("p_partkey") % n).cast("int")
    base = F.when(k == n - 1, F.col("p_brand")).otherwise(
        F.element_at(F.array(*[F.lit(c) for c in HEADER_CANDIDATES]), k + 1))
    h = F.when(F.col("p_size") % 3 == 0, F.upper(base)) \
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("  "), base, F.lit(" "))).otherwise(base)
    d = p.select("p_partkey", h.alias("header"))
    return d.select("p_partkey", "header", ex.canonical_header(F.col("header")).alias("canonical"),
                    ex.canonical_header(F.col("header"), ex.HEADER_ALIASES_API).alias("api_canonical"))


LINE_SUFFIXES = [",", ",,", ", ", ",\t", "\r", "  ", ""]


@query("line_cleanup", f"""WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_orderkey % 2 = 0 THEN '  ' ELSE '' END || CAST(l_orderkey AS VARCHAR) || ',' ||
         CAST(l_partkey AS VARCHAR) || ',' || l_returnflag ||
         [{', '.join("'" + s.replace(chr(9), "' || chr(9) || '").replace(chr(13), "' || chr(13) || '") + "'" for s in LINE_SUFFIXES)}][(l_linenumber - 1) % {len(LINE_SUFFIXES)} + 1] AS raw
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(rtrim(raw, ','), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned
FROM r""")
def q_line_cleanup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_returnflag")
    suffix = F.element_at(F.array(*[F.lit(s) for s in LINE_SUFFIXES]),
                          ((F.col("l_linenumber") - 1) % len(LINE_SUFFIXES) + 1).cast("int"))
    raw = F.concat(F.when(F.col("l_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("")),
                   F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                               "l_returnflag"), suffix)
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("line"))
    # S6 without S7: blank results are kept here so every line is reported
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    ex.clean_line(F.col("line")).alias("cleaned"))


@query("numeric_coerce", """WITH t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE l_linenumber WHEN 1 THEN CAST(q AS DOUBLE) WHEN 2 THEN CAST(q AS DOUBLE) WHEN 7 THEN CAST(q * 10 AS DOUBLE)
            WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CAST(p AS DOUBLE) END AS dated_value,
       CASE l_linenumber WHEN 1 THEN CAST(q AS DOUBLE) WHEN 2 THEN CAST(q AS DOUBLE) WHEN 7 THEN CAST(q * 10 AS DOUBLE)
            WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 WHEN 5 THEN 0.0 WHEN 6 THEN 0.0 ELSE CAST(p AS DOUBLE) END AS menu_value
FROM t""")
def q_numeric_coerce(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_quantity", "l_extendedprice")
    q = F.col("l_quantity").cast("bigint").cast("string")
    ln = F.col("l_linenumber")
    text = (F.when(ln == 1, q).when(ln == 2, F.concat(F.lit(" "), q, F.lit(" ")))
            .when(ln == 3, F.concat(q, F.lit("d"))).when(ln == 4, F.concat(F.lit("1,"), q))
            .when(ln == 5, F.lit("inf")).when(ln == 6, F.lit("NaN")).when(ln == 7, F.concat(q, F.lit("e1")))
            .otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("t"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    co.numeric_or_null(F.col("t")).cast("double").alias("dated_value"),
                    co.numeric_or_zero(F.col("t")).cast("double").alias("menu_value"))


@query("date_coerce", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber IN (4, 5, 6) THEN NULL ELSE strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') END AS parsed
FROM lineitem""")
def q_date_coerce(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_shipdate")
    d = F.col("l_shipdate").cast("date")
    ln = F.col("l_linenumber")
    text = (F.when(ln == 1, F.date_format(d, "yyyy-MM-dd")).when(ln == 2, F.date_format(d, "M/d/yyyy"))
            .when(ln == 3, F.date_format(d, "yyyy/M/d")).when(ln == 4, F.concat(F.year(d).cast("string"), F.lit("-13-01")))
            .when(ln == 5, F.lit("")).when(ln == 6, F.lit("not a date"))
            .otherwise(F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" "))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.date_format(co.lenient_date(text), "yyyy-MM-dd").alias("parsed"))


#: By store: how its exports spell dates.  The second and third can only be told apart by a day over twelve.
STORE_SPELLINGS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "MMM d, yyyy")


@query("date_spelling", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d,
       max(day(l_shipdate)) FILTER (WHERE l_linenumber <> 6) OVER (PARTITION BY l_suppkey) > 12 AS sure FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  strftime(CASE WHEN l_linenumber <> 6 THEN CASE WHEN l_suppkey % 5 <> 1 OR sure THEN d ELSE make_date(year(d), day(d), month(d)) END END, '%Y-%m-%d') AS parsed
FROM t""")
def q_date_spelling(spark, sf_dir):
    """F4 by column: every store writes its dates in a spelling of its own."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
    spelt = F.lit(None).cast("string")
    for k, spelling in enumerate(STORE_SPELLINGS):
        spelt = F.when(F.col("l_suppkey") % 5 == k, F.date_format("d", spelling)).otherwise(spelt)
    text = F.when(F.col("l_linenumber") == 6, F.lit("n.d.")).when(F.col("l_linenumber") == 2, F.concat(spelt, F.lit(" 18:05"))).otherwise(spelt)
    dated = co.dates_by_upload(li.withColumn("text", text), ["l_suppkey"], "text", "parsed")
    return dated.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("parsed", "yyyy-MM-dd").alias("parsed"))


LAYOUT_COLUMNS = ["date", "item_name", "quantity", "category", "net_sales"]


def _py_list_sql(lst: str) -> str:
    return "'[' || coalesce(array_to_string(list_transform(" + lst + ", lambda x: '''' || x || ''''), ', '), '') || ']'"


@query("layout_detect", f"""WITH h AS (
  SELECT s_suppkey, list_filter([{', '.join(sq(c) for c in LAYOUT_COLUMNS)}], lambda x, i: ((s_suppkey >> (i - 1)) & 1) = 1) AS cols
  FROM supplier),
m AS (SELECT *, list_filter(['date', 'item_name', 'quantity', 'category'], lambda x: NOT list_contains(cols, x)) AS missing,
             CASE WHEN list_contains(cols, 'item_name') AND list_contains(cols, 'category') THEN 'menu'
                  WHEN list_contains(cols, 'date') THEN 'dated' ELSE 'unrecognised' END AS layout FROM h)
SELECT s_suppkey, array_to_string(cols, ',') AS columns, layout,
       CASE WHEN layout = 'dated' THEN 'Missing required columns: ' || {_py_list_sql('missing')}
            WHEN layout = 'unrecognised' THEN 'CSV format not recognized. Available columns: ' || {_py_list_sql('cols')}
       END AS error
FROM m""")
def q_layout_detect(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    cols = F.filter(F.array(*[F.lit(c) for c in LAYOUT_COLUMNS]),
                    lambda x, i: (F.col("s_suppkey") / F.pow(F.lit(2), i)).cast("bigint") % 2 == 1)
    d = s.select("s_suppkey", cols.alias("cols"))
    d = d.withColumn("layout", ex.layout_of(F.col("cols"))).withColumn("missing", ex.missing_columns(F.col("cols")))
    return d.select("s_suppkey", F.array_join("cols", ",").alias("columns"), "layout",
                    ex.layout_error(F.col("layout"), F.col("cols"), F.col("missing")).alias("error"))


@query("required_columns", f"""WITH h AS (
  SELECT s_suppkey, list_filter([{', '.join(sq(c) for c in LAYOUT_COLUMNS)}], lambda x, i: ((s_suppkey >> (i - 1)) & 1) = 1) AS cols
  FROM supplier)
SELECT s_suppkey, array_to_string(list_filter(['date', 'item_name', 'quantity', 'category'],
                                              lambda x: NOT list_contains(cols, x)), ',') AS missing FROM h""")
def q_required_columns(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    cols = F.filter(F.array(*[F.lit(c) for c in LAYOUT_COLUMNS]),
                    lambda x, i: (F.col("s_suppkey") / F.pow(F.lit(2), i)).cast("bigint") % 2 == 1)
    return s.select("s_suppkey", F.array_join(ex.missing_columns(cols), ",").alias("missing"))


ITEM_VARIANTS = 7


@query("drop_blank_items", f"""WITH r AS (SELECT p_partkey, CASE p_partkey % {ITEM_VARIANTS}
    WHEN 0 THEN p_name WHEN 1 THEN '  ' || p_name || chr(9) WHEN 2 THEN '' WHEN 3 THEN 'None'
    WHEN 4 THEN 'null' WHEN 5 THEN 'N/A' ELSE 'NA ' END AS raw FROM part)
SELECT p_partkey, raw,
       CASE WHEN p_partkey % {ITEM_VARIANTS} IN (0, 1) THEN trim(raw, ' ' || chr(9))
            WHEN p_partkey % {ITEM_VARIANTS} = 6 THEN 'NA' ELSE '' END AS item_name,
       p_partkey % {ITEM_VARIANTS} IN (0, 1, 6) AS kept
FROM r""")
def q_drop_blank_items(spark, sf_dir):
    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % ITEM_VARIANTS
    raw = (F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("  "), "p_name", F.lit("\t")))
           .when(k == 2, F.lit("")).when(k == 3, F.lit("None")).when(k == 4, F.lit("null"))
           .when(k == 5, F.lit("N/A")).otherwise(F.lit("NA ")))
    d = p.select("p_partkey", raw.alias("raw"))
    name = ex.drop_blank_name(F.col("raw"))
    return d.select("p_partkey", "raw", name.alias("item_name"), (name != "").alias("kept"))


@query("menu_item_filter", """SELECT l_suppkey AS store_id,
  count(*) FILTER (WHERE l_returnflag = 'N') AS kept, count(*) FILTER (WHERE l_returnflag <> 'N') AS dropped
FROM lineitem GROUP BY l_suppkey""")
def q_menu_item_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    t = F.when(F.col("l_returnflag") == "N", F.lit("menuItem")).when(F.col("l_returnflag") == "R", F.lit("menuitem")) \
        .otherwise(F.lit("modifier"))
    ok = ex.type_accepted(F.lit(True), t)
    return li.groupBy(F.col("l_suppkey").alias("store_id")).agg(F.count_if(ok).alias("kept"),
                                                                F.count_if(~ok).alias("dropped"))


@query("utf8_check", """SELECT doc_id, octet_length(encode(text)) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_bytes,
  doc_id % 7 <> 0 AS is_valid FROM documents""")
def q_utf8_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = F.encode("text", "UTF-8")
    b = F.when(F.col("doc_id") % 7 == 0, F.concat(b, F.unhex(F.lit("FF")))).otherwise(b)
    x = d.select("doc_id", b.alias("b"))
    return x.select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"),
                    ex.valid_text(F.col("b").cast("string")).alias("is_valid"))


NAME_SUFFIXES = [".csv", ".CSV", ".txt", ""]


@query("csv_name_filter", f"""WITH n AS (SELECT page_id,
  coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '([^/]*)$', 1), ''), 'index')
  || [{', '.join(sq(s) for s in NAME_SUFFIXES)}][page_id % 4 + 1] AS name FROM pages)
SELECT page_id, name, suffix(name, '.csv') AS accepted FROM n""")
def q_csv_name_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    last = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.lit("index"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in NAME_SUFFIXES]), (F.col("page_id") % 4 + 1).cast("int"))
    d = p.select("page_id", F.concat(last, suffix).alias("name"))
    return d.select("page_id", "name", ex.accepted_name(F.col("name")).alias("accepted"))


@query("subtotal_reconcile", with_sales(f"""c AS (SELECT store_id, period, category, sum(quantity) AS q, sum(net_sales) AS n,
       coalesce(sum(quantity) FILTER (WHERE NOT (store_id % 5 = 0 AND quantity = 7)), 0) AS iq,
       coalesce(sum(net_sales) FILTER (WHERE NOT (store_id % 5 = 0 AND quantity = 7)), 0) AS inet
                                      FROM sales GROUP BY store_id, period, category)
SELECT store_id, period, category, {int_sql('iq')} AS item_qty, {money_sql('inet')} AS item_net,
       {int_sql('q')} AS subtotal_qty, {money_sql('n')} AS subtotal_net, {int_sql('q - iq')} AS qty_diff,
       {money_sql('n - inet')} AS net_diff FROM c"""))
def q_subtotal_reconcile(spark, sf_dir):
    """Every fifth store's exports lost the item rows of seven units; the subtotal rows still count them."""
    rows = qa.with_subtotals(_sales(spark, sf_dir), ["store_id", "period"])
    lost = (F.col("store_id") % 5 == 0) & (F.col("quantity") == 7) & (F.col("item_name") != "")
    return qa.reconcile_subtotals(rows.filter(~lost), ["store_id", "period"])


DUP_COLS = ["store_id", "period", "category", "item_name", "date", "quantity", "gross_sales",
            "discount_amount", "net_sales"]


@query("duplicate_rows", with_sales("""d AS (SELECT store_id, period, category, item_name, date, quantity, gross_sales,
                                          discount_amount, net_sales, count(*) AS copies
                                   FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales WHERE quantity >= 45)
                                   GROUP BY ALL HAVING count(*) > 1)
SELECT store_id, period, category, item_name, strftime(date, '%Y-%m-%d') AS date, CAST(quantity AS DOUBLE) AS quantity,
       CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(discount_amount AS DOUBLE) AS discount_amount,
       CAST(net_sales AS DOUBLE) AS net_sales, copies FROM d"""))
def q_duplicate_rows(spark, sf_dir):
    s = _sales(spark, sf_dir).select(*DUP_COLS)
    d = qa.duplicate_rows(s.unionByName(s.filter(F.col("quantity") >= 45)), DUP_COLS)  # large orders were exported twice
    return d.select("store_id", "period", "category", "item_name", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    *[F.col(c).cast("double").alias(c) for c in ("quantity", "gross_sales", "discount_amount",
                                                                 "net_sales")], "copies")


# ---------------------------------------------------------------- X1-X3, P12, F17, F19-F22
from ..operators import content as ct  # noqa: E402
from ..operators import prompts as pr  # noqa: E402


def _store_summary(spark, sf_dir):
    """The sales and their top items, top categories and insights.  The sales are gathered by store, so that all sums are nearly done
    before they are shuffled; the top items, a few rows a store, are written, since prompts read them in several places."""
    s = _gathered_sales(spark, sf_dir)
    top = stored(agg.top_items(s, STORE, 5, with_revenue=True), "top-items")
    cats = agg.top_categories(s, STORE, 5, with_revenue=True)
    insight_rows = ins.insights(s, STORE, premium_price=PREMIUM_PRICE, gathered=True)
    return s, top, cats, insight_rows


def _prompt_sql(api: bool, focus: bool) -> str:
    units = "units" if api else "units sold"
    closing = pr.CLOSING_LINES_API if api else pr.CLOSING_LINES
    close_sql = " UNION ALL ".join(f"SELECT store_id, 5, {i}, {sq(t)} FROM g" for i, t in enumerate(closing))
    focus_sql = ""
    if focus:
        parts = []
        for i, t in enumerate(pr.FOCUS_LINES + ("",)):
            line = sq(t) if "{item}" not in t else (sq(t.split("{item}")[0]) + " || item_name || "
                                                     + sq(t.split("{item}")[1]))
            parts.append(f"SELECT store_id, 1, {i}, {line} FROM focus")
        focus_sql = "UNION ALL " + " UNION ALL ".join(parts)
    return with_sales(ITEMS_SQL.format(g="store_id,") + ",\n" + INSIGHTS_CTES + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY q DESC, item_name) AS rk FROM items),
ti AS (SELECT store_id, rk, item_name, {int_sql('q')} AS quantity, {money_sql('n')} AS net_sales,
              {mean_sql('ps', 'pn')} AS avg_price FROM ranked WHERE rk <= 5),
tc AS (SELECT store_id, rk, category, {int_sql('q')} AS quantity, {money_sql('n')} AS net_sales
       FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS rk FROM cats) WHERE rk <= 5),
g AS (SELECT DISTINCT store_id FROM ti),
focus AS (SELECT t.store_id, t.item_name FROM ti t JOIN toprev r ON r.store_id = t.store_id AND r.rk = 1
          AND r.item_name = t.item_name),
lines AS (
  SELECT store_id, 0 AS s, 0 AS k, {sq(pr.HEADER_LINE)} AS line FROM g UNION ALL
  SELECT store_id, 0, 1, '' FROM g UNION ALL
  SELECT store_id, 2, 0, {sq(pr.ITEMS_TITLE)} FROM g UNION ALL
  SELECT store_id, 2, rk, '- ' || item_name || ': ' || CAST(quantity AS VARCHAR) || ' {units}' ||
         CASE WHEN coalesce(net_sales, 0) <> 0 THEN ', $' || format('{{:,.2f}}', net_sales) || ' revenue, $'
              || printf('%.2f', avg_price) || ' avg price' ELSE '' END FROM ti UNION ALL
  SELECT store_id, 2, 1048576, '' FROM g UNION ALL
  SELECT store_id, 3, 0, {sq(pr.CATS_TITLE)} FROM g UNION ALL
  SELECT store_id, 3, rk, '- ' || category || ': ' || CAST(quantity AS VARCHAR) || ' units' ||
         CASE WHEN coalesce(net_sales, 0) <> 0 THEN ', $' || format('{{:,.2f}}', net_sales) || ' revenue' ELSE '' END
  FROM tc UNION ALL
  SELECT store_id, 3, 1048576, '' FROM g UNION ALL
  SELECT store_id, 4, 0, {sq(pr.INSIGHTS_TITLE)} FROM g UNION ALL
  SELECT store_id, 4, seq, '- ' || text FROM ins UNION ALL
  SELECT store_id, 4, 1048576, '' FROM g UNION ALL
  {close_sql} {focus_sql})
SELECT store_id, string_agg(line, chr(10) ORDER BY s, k) AS prompt FROM lines GROUP BY store_id""")


@query("prompt_focus", _prompt_sql(api=False, focus=True))
def q_prompt_focus(spark, sf_dir):
    s, top, cats, insight_rows = _store_summary(spark, sf_dir)
    sel = ins.top_revenue_row(s, STORE).select(*STORE, F.col("item_name").alias("selected_item"))
    return pr.user_prompt(top, cats, insight_rows, STORE, selections=sel)


@query("prompt_variant", _prompt_sql(api=True, focus=False))
def q_prompt_variant(spark, sf_dir):
    _, top, cats, insight_rows = _store_summary(spark, sf_dir)
    return pr.user_prompt(top, cats, insight_rows, STORE, variant="api")


PLATFORM_CHOICES = ["instagram", "tiktok", "actions", "facebook"]


@query("prompt_platform", _prompt_sql(api=False, focus=False).replace(
    "SELECT store_id, string_agg(line, chr(10) ORDER BY s, k) AS prompt FROM lines GROUP BY store_id",
    f""", pp AS (SELECT store_id, string_agg(line, chr(10) ORDER BY s, k) AS prompt FROM lines GROUP BY store_id),
rq AS (SELECT p.store_id, [{', '.join(sq(x) for x in PLATFORM_CHOICES)}][p.store_id % 4 + 1] AS platform,
              p.store_id + 1000 AS nonce, t.item_name AS prev FROM pp p LEFT JOIN ti t ON t.store_id = p.store_id AND t.rk = 1
       UNION ALL SELECT DISTINCT -store_id - 1, 'instagram', 1000, NULL FROM pp WHERE store_id % 10 = 0),
tp AS (SELECT [{', '.join(sq(x) for x in PLATFORM_CHOICES)}][r_regionkey + 1] AS platform, 'Write for ' || r_name AS system_prompt
       FROM region WHERE r_regionkey < 3)
SELECT store_id, platform, CASE WHEN platform <> 'facebook' THEN system_prompt END AS system_prompt,
  CASE WHEN platform <> 'facebook' THEN prompt || chr(10) || chr(10) || 'nonce=' || CAST(nonce AS VARCHAR) || chr(10) ||
       CASE WHEN platform = 'instagram' THEN 'previous_text=' || prev || chr(10) || {sq(pr.NEW_VARIATION_LINE)} || chr(10) ELSE '' END
  END AS user_prompt,
  CASE WHEN platform = 'facebook' THEN 'platform must be one of: instagram, tiktok, actions' WHEN prompt IS NULL THEN {sq(pr.NO_SUMMARY)} END AS error
FROM rq LEFT JOIN pp USING (store_id) LEFT JOIN tp USING (platform)"""))
def q_prompt_platform(spark, sf_dir):
    _, top, cats, insight_rows = _store_summary(spark, sf_dir)
    prompts = pr.user_prompt(top, cats, insight_rows, STORE)
    first = top.filter(F.col("rank") == 1).select(*STORE, F.col("item_name").alias("_first"))
    platform = F.element_at(F.array(*[F.lit(x) for x in PLATFORM_CHOICES]), (F.col("store_id") % 4 + 1).cast("int"))
    req = first.select(
        *STORE, platform.alias("platform"), (F.col("store_id") + 1000).alias("nonce"),
        F.when(platform == "instagram", F.col("_first")).alias("previous_text"))
    # some requests name a store that has no summary; the templates are a table
    none = req.filter(F.col("store_id") % 10 == 0).select(
        (-F.col("store_id") - 1).alias("store_id"), F.lit("instagram").alias("platform"), F.lit(1000).cast("bigint").alias("nonce"),
        F.lit(None).cast("string").alias("previous_text"))
    templates = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(
        F.element_at(F.array(*[F.lit(x) for x in PLATFORM_CHOICES]), F.col("r_regionkey") + 1).alias("platform"),
        F.concat(F.lit("Write for "), "r_name").alias("system_prompt"))
    return pr.platform_prompt(prompts, req.unionByName(none), STORE, templates)


@query("post_text", """SELECT p_partkey, p_name || chr(10) || chr(10) || '#' || replace(p_brand, '#', '') || ' #' || lower(p_type)
  AS instagram_text FROM part""")
def q_post_text(spark, sf_dir):
    p = _part(spark, sf_dir)
    tags = F.array(F.concat(F.lit("#"), F.regexp_replace("p_brand", "#", "")), F.concat(F.lit("#"), F.lower("p_type")))
    return p.select("p_partkey", tx.post_text(F.col("p_name"), tags).alias("instagram_text"))


def _ideas_col():
    return F.array(F.struct(F.concat(F.lit("Feature "), "p_name").alias("text"), F.lit("top seller").alias("reason")),
                   F.struct(F.concat(F.lit("Bundle "), "p_type").alias("text"), F.col("p_brand").alias("reason")))


@query("ideas_join", """SELECT p_partkey, 'Feature ' || p_name || ' | Bundle ' || p_type AS previous_text,
  'Feature ' || p_name || chr(10) || chr(10) || 'Bundle ' || p_type AS copy_text FROM part""")
def q_ideas_join(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_partkey", _ideas_col().alias("ideas"))
    return p.select("p_partkey", tx.join_idea_texts("ideas", " | ").alias("previous_text"),
                    tx.join_idea_texts("ideas", "\n\n").alias("copy_text"))


@query("actions_to_ideas", """SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_type AS idea_texts,
  'Refreshed suggestion|Refreshed suggestion|Refreshed suggestion' AS reasons FROM part""")
def q_actions_to_ideas(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("actions"))
    ideas = p.select("p_partkey", tx.actions_to_ideas(F.col("actions")).alias("ideas"))
    return ideas.select("p_partkey", tx.join_idea_texts("ideas", " | ").alias("idea_texts"),
                        F.array_join(F.transform("ideas", lambda i: i["reason"]), "|").alias("reasons"))


@query("section_replace", """WITH t AS (SELECT *, ['instagram', 'tiktok', 'actions', 'facebook'][p_partkey % 4 + 1] AS platform FROM part)
SELECT p_partkey, platform,
  CASE WHEN platform = 'instagram' THEN 'New ' || p_name ELSE p_name END AS ig_caption,
  CASE WHEN platform = 'instagram' THEN '#new' ELSE '#' || lower(p_type) END AS ig_hashtags,
  CASE WHEN platform = 'tiktok' THEN 'New ' || p_name ELSE p_name || ' size ' || CAST(p_size AS VARCHAR) END AS tt_caption,
  CASE WHEN platform = 'actions' THEN 'a1 | a2 | ' || p_brand ELSE 'Feature ' || p_name || ' | Bundle ' || p_type END AS idea_texts,
  CASE WHEN platform = 'actions' THEN 'Refreshed suggestion' ELSE 'top seller' END AS first_reason
FROM t""")
def q_section_replace(spark, sf_dir):
    p = _part(spark, sf_dir)
    doc = F.struct(F.struct(F.col("p_name").alias("caption"),
                            F.array(F.concat(F.lit("#"), F.lower("p_type"))).alias("hashtags")).alias("instagram"),
                   F.struct(F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string")).alias("caption"),
                            F.array(F.concat(F.lit("#"), F.lower("p_type"))).alias("hashtags")).alias("tiktok"),
                   _ideas_col().alias("promotion_ideas"))
    platform = F.element_at(F.array(*[F.lit(x) for x in PLATFORM_CHOICES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    post = F.struct(F.concat(F.lit("New "), "p_name").alias("caption"), F.array(F.lit("#new")).alias("hashtags"))
    actions = F.array(F.lit("a1"), F.lit("a2"), F.col("p_brand"))
    d = p.select("p_partkey", platform.alias("platform"),
                 ct.replace_section(doc, platform, post, actions).alias("doc"))
    return d.select("p_partkey", "platform", F.col("doc.instagram.caption").alias("ig_caption"),
                    F.array_join("doc.instagram.hashtags", " ").alias("ig_hashtags"),
                    F.col("doc.tiktok.caption").alias("tt_caption"),
                    tx.join_idea_texts("doc.promotion_ideas", " | ").alias("idea_texts"),
                    F.get(F.col("doc.promotion_ideas"), 0)["reason"].alias("first_reason"))


# ---------------------------------------------------------------- T1, T2, S11 (Structured Streaming)
from ..streaming import dropfolder as dfs  # noqa: E402


@query("stream_compare", _panel_old_sql(LAG_PAIRS_SQL))
def q_stream_compare(spark, sf_dir):
    """Uploads arrive in two drops; each drop is one micro-batch; the second
    compares against the snapshot the first one wrote."""
    base = scratch_path(spark, "stream-compare")
    s = _sales(spark, sf_dir).select("store_id", "period", "item_name", "quantity")
    # split point: the middle of the period span (a one-row aggregate)
    lo, hi = s.agg(F.min("period"), F.max("period")).first()
    split = (lo + hi) // 2
    schema = s.schema
    ckpt, snap, panels = f"{base}/checkpoint", f"{base}/snapshot", f"{base}/panels"
    s.filter(F.col("period") <= split).write.parquet(f"{base}/drop/a")
    dfs.compare_stream(spark, f"{base}/drop", schema, snap, panels, ckpt, STORE, "period")
    s.filter(F.col("period") > split).write.parquet(f"{base}/drop/b")
    dfs.compare_stream(spark, f"{base}/drop", schema, snap, panels, ckpt, STORE, "period")
    return dfs.latest_panels(spark, panels, STORE)


@query("stream_summary", _panel_old_sql(LAG_PAIRS_SQL))
def q_stream_summary(spark, sf_dir):
    """A23 with T2: the documents of uploads that arrive in two drops, and the panels in them."""
    base, path = scratch_path(spark, "stream-summary"), scratch_path(spark, "sales-rows")
    write_lean(sales_rows(spark, sf_dir), path)
    s = sales_columns(spark.read.parquet(path))
    lo, hi = s.agg(F.min("period"), F.max("period")).first()
    for name, part in (("a", F.col("period") <= (lo + hi) // 2), ("b", F.col("period") > (lo + hi) // 2)):
        write_lean(s.filter(part), f"{base}/drop/{name}")
        if name == "b":
            published.delete_path(spark, path)  # all of it has been dropped
        dfs.summary_stream(spark, f"{base}/drop", s.schema, base, f"{base}/checkpoint", STORE, "period", premium_price=PREMIUM_PRICE)
    docs = dfs.latest_summaries(spark, base, [*STORE, "period"])
    panels = docs.select("store_id", F.col("period").alias("curr_upload"), F.explode("previous_panel").alias("p")).select("store_id", "curr_upload", "p.*")
    pairs = cmp.successive_pairs(docs.select("store_id", "period"), STORE, "period")
    want = dfs.latest_panels(spark, f"{base}/panels", STORE).columns
    return panels.join(pairs, ["store_id", "curr_upload"]).select(*want)


@query("stream_status", f"""WITH {PROGRESS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, seq DESC) AS rk,
             count(*) OVER (PARTITION BY request_id) AS n_events FROM pe)
SELECT request_id, n_events, seq, status, partial, error FROM r WHERE rk = 1""")
def q_stream_status(spark, sf_dir):
    """T3 over a stream of progress events that arrive in two drops, the second one later in time.  A request is followed
    over a month of silence; events that are an hour late would be dropped."""
    base = scratch_path(spark, "stream-status")
    pe = progress_events(spark, sf_dir).select("request_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "status", "partial", "error")
    middle = F.lit(pe.agg(F.timestamp_micros((F.min(F.unix_micros("ts")) / 2 + F.max(F.unix_micros("ts")) / 2).cast("bigint"))).first()[0])
    for name, part in (("a", F.col("ts") <= middle), ("b", F.col("ts") > middle)):
        pe.filter(part).write.parquet(f"{base}/drop/{name}")
        events = spark.readStream.schema(pe.schema).option("recursiveFileLookup", "true").parquet(f"{base}/drop")
        dfs.status_stream(events, f"{base}/out", f"{base}/checkpoint", "request_id", ["ts", "seq"], "ts",
                          ["seq", "status", "partial", "error"], late="1 hour", idle="31 days")
    last = dfs._latest(spark.read.parquet(f"{base}/out"), ["request_id"])
    return last.select("request_id", "n_events", "seq", "status", "partial", "error")


@query("stream_progress", REGISTRY["reply_progress"][1])
def q_stream_progress(spark, sf_dir):
    """T4 over a stream of chunks that arrive out of order, over two drops; a turn a minute stands in for their time."""
    base = scratch_path(spark, "stream-progress")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds((F.col("turn") + 1) * 60).alias("at"))  # after the first watermark, 0
    second = F.xxhash64("conv_id", "turn") % 2 == 0
    for name, part in (("a", ~second), ("b", second)):
        c.filter(part).write.parquet(f"{base}/drop/{name}")
        chunks = spark.readStream.schema(c.schema).option("recursiveFileLookup", "true").parquet(f"{base}/drop")
        dfs.progress_stream(chunks, f"{base}/out", f"{base}/checkpoint", "conv_id", "turn", "at", late="1 hour")
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "role", "partial")


@query("stream_ingest", with_sales("""u AS (SELECT store_id, period, count(*) AS n_rows, sum(quantity) AS q, sum(net_sales) AS n
                                    FROM sales GROUP BY store_id, period)
SELECT store_id, period, n_rows, CAST(q AS DOUBLE) AS quantity, CAST(round(n, 2) AS DOUBLE) AS net_sales FROM u"""))
def q_stream_ingest(spark, sf_dir):
    """Every (store, year) becomes one CSV export in a drop folder; the stream
    ingests them in micro-batches of files."""
    base = scratch_path(spark, "stream-ingest")
    s = _sales(spark, sf_dir).select("store_id", "period", "category", "item_name", "quantity", "net_sales")
    s.repartition("store_id", "period").write.partitionBy("store_id", "period") \
        .option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(f"{base}/drop")  # files are put in place by the tasks
    dfs.ingest_stream(spark, f"{base}/drop", f"{base}/out", f"{base}/checkpoint")
    got = spark.read.parquet(f"{base}/out/sales")
    keyed = got.select(F.regexp_extract("upload_id", r"store_id=(\d+)", 1).cast("bigint").alias("store_id"),
                       F.regexp_extract("upload_id", r"period=(\d+)", 1).cast("int").alias("period"),
                       "quantity", "net_sales")
    return keyed.groupBy("store_id", "period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").cast("double").alias("quantity"),
        _money_out(F.sum("net_sales")).alias("net_sales"))


# ---------------------------------------------------------------- A23, S10 (nested document)
from . import summary as sm  # noqa: E402


#: Every fourth store's exports have quantities only.
def _mixed_layouts(sales: DataFrame) -> DataFrame:
    has = F.col("store_id") % 4 != 0
    return sales.withColumns({c: F.when(has, F.col(c)) for c in ("net_sales", "discount_amount", "avg_price")} | {"has_revenue": has})


MIXED_SALES = SALES_CTE.replace("sales AS", "full_sales AS", 1) + """,
sales AS (SELECT * REPLACE (CASE WHEN store_id % 4 <> 0 THEN net_sales END AS net_sales,
                            CASE WHEN store_id % 4 <> 0 THEN discount_amount END AS discount_amount,
                            CASE WHEN store_id % 4 <> 0 THEN avg_price END AS avg_price) FROM full_sales)"""

SUMMARY_SQL = f"""WITH {MIXED_SALES},
{ITEMS_SQL.format(g="store_id,")},
{INSIGHTS_CTES},
{MONTH_TOP_SQL},
trend AS (SELECT store_id, month_rank, 'Higher ' || lower(category) || ' sales in ' || month AS text FROM mr WHERE month_rank <= 2),
every_ins AS (SELECT store_id, seq, type, text FROM ins
              UNION ALL SELECT store_id, CAST(month_rank + 1 AS INTEGER), 'trend', text FROM trend WHERE store_id % 4 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY q DESC, item_name) AS rk FROM items),
top AS (SELECT *, {int_sql('q')} AS quantity, {money_sql('n')} AS net, {mean_sql('ps', 'pn')} AS price,
               row_number() OVER (PARTITION BY store_id ORDER BY round(n, 2) DESC NULLS LAST, rk) AS rr FROM ranked WHERE rk <= 5),
bench AS (SELECT store_id, max(quantity) AS mq, max(coalesce(net, 0)) AS max_net FROM top GROUP BY store_id),
tc AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY CASE WHEN store_id % 4 <> 0 THEN n ELSE q END DESC, category) AS rk FROM cats),
dr AS (SELECT store_id, min(date) AS a, max(date) AS b FROM sales GROUP BY store_id)
SELECT t.store_id, 'item' AS part, CAST(rk AS INTEGER) AS rank, item_name AS name, quantity, net AS net_sales, price AS avg_price,
       CASE WHEN quantity = mq AND quantity > 0 THEN 'hot' WHEN net = max_net AND net > 0 THEN 'revenue'
            WHEN coalesce(price, 0) >= {PREMIUM_PRICE} AND quantity * 10 > mq * 3 THEN 'premium'
            WHEN quantity * 10 >= mq * 7 AND quantity < mq THEN 'rising' END AS tag,
       nullif(concat_ws(', ', CASE WHEN rk = 1 THEN 'Hot Seller' END, CASE WHEN rr = 1 AND net IS NOT NULL THEN 'Premium Performer' END), '') AS badge,
       CAST(NULL AS VARCHAR) AS text
FROM top t JOIN bench b ON t.store_id = b.store_id
UNION ALL
SELECT store_id, 'category', CAST(rk AS INTEGER), category, {int_sql('q')}, {money_sql('n')}, NULL, NULL,
       CASE WHEN rk = 1 AND n IS NOT NULL THEN 'High Revenue Driver' END, NULL FROM tc WHERE rk <= 5
UNION ALL
SELECT store_id, 'insight', seq, type, NULL, NULL, NULL, NULL, NULL, text FROM every_ins
UNION ALL
SELECT store_id, 'dates', 1, strftime(a, '%b %d, %Y') || ' / ' || strftime(b, '%b %d, %Y'), NULL, NULL, NULL, NULL, NULL,
       strftime(a, '%B ') || CAST(day(a) AS VARCHAR) || strftime(a, ', %Y') || ' – ' || strftime(b, '%B ') || CAST(day(b) AS VARCHAR) || strftime(b, ', %Y')
FROM dr"""


def _summary(spark, sf_dir) -> DataFrame:
    sales = _mixed_layouts(_sales_table(spark, sf_dir))
    flags = {f: F.col("has_revenue") for f in ("has_net_sales", "has_discount", "has_avg_price")}
    return sm.summary_document(sales, STORE, premium_price=PREMIUM_PRICE, flags=flags | {"has_date": F.lit(True)})


def _summary_rows(doc: DataFrame) -> DataFrame:
    """Every field of the nested document, one row for each entry of its lists."""
    none = lambda t: F.lit(None).cast(t)

    def part(name, rows, rank, title, quantity=none("bigint"), net=none("double"), price=none("double"), tag=none("string"),
             badge=none("string"), text=none("string")):
        return rows.select("store_id", F.lit(name).alias("part"), rank.cast("int").alias("rank"), title.alias("name"), quantity.alias("quantity"),
                           net.alias("net_sales"), price.alias("avg_price"), tag.alias("tag"), badge.alias("badge"), text.alias("text"))

    x = F.col
    items = doc.select("store_id", F.explode("top_items").alias("e"))
    cats = doc.select("store_id", F.explode("top_categories").alias("e"))
    notes = doc.select("store_id", F.posexplode("insights").alias("p", "e"))
    return (part("item", items, x("e.rank"), x("e.item_name"), x("e.quantity"), x("e.net_sales"), x("e.avg_price"), x("e.performance_tag.type"), x("e.badge"))
            .unionByName(part("category", cats, x("e.rank"), x("e.category"), x("e.quantity"), x("e.net_sales"), badge=x("e.badge")))
            .unionByName(part("insight", notes, x("p") + 1, x("e.type"), text=x("e.text")))
            .unionByName(part("dates", doc, F.lit(1), F.concat_ws(" / ", "date_range.start", "date_range.end"), text=x("data_period"))))


@query("summary_document", SUMMARY_SQL)
def q_summary_document(spark, sf_dir):
    """A23 over stores with and without a revenue column, every field compared."""
    return _summary_rows(_summary(spark, sf_dir))


@query("summary_json", SUMMARY_SQL)
def q_summary_json(spark, sf_dir):
    """One JSON reply per store, read back and compared field by field."""
    doc = _summary(spark, sf_dir)
    body = sm.summary_json(doc, STORE)
    read = F.from_json("summary_json", doc.drop("store_id").schema)
    return _summary_rows(body.select("store_id", read.alias("d")).select("store_id", "d.*"))


def _published(spark, sf_dir):
    """Two versions of the summaries: of the exports up to a year, then of all; readers get the second."""
    base = scratch_path(spark, "published")
    sales = _mixed_layouts(_sales_table(spark, sf_dir))
    middle = sales.agg(F.floor((F.min("period") + F.max("period")) / 2)).first()[0]
    flags = {f: F.col("has_revenue") for f in ("has_net_sales", "has_discount", "has_avg_price")} | {"has_date": F.lit(True)}
    for rows in (sales.filter(F.col("period") <= middle), sales):
        sm.publish_summaries(spark, base, rows, STORE, premium_price=PREMIUM_PRICE, flags=flags)
    return published.current(spark, base)



@query("summary_published", SUMMARY_SQL)
def q_summary_published(spark, sf_dir):
    """The documents as a reader of the published folder gets them."""
    return _summary_rows(_published(spark, sf_dir).read("summary"))


@query("published_items", _tag_sql(False))
def q_published_items(spark, sf_dir):
    """A3 + S11: the full tagged item lists beside the documents."""
    return _flat_tag(_published(spark, sf_dir).read("all_items"))

"""Properties of the aggregate operators on the sf0.001 tables.

* item and category roll-ups of one group agree on total units;
* category revenue shares of a group add up to 100;
* rank 1 of a top list carries the hot tag;
* results do not depend on how the input is partitioned or ordered;
* the result for one group equals the result on that group alone;
* the keyless (whole table) paths match a plain sort of the same rows.
"""

import os

import pytest
from pyspark.sql import functions as F

from tillsight.operators import aggregate as agg
from tillsight.operators import insights as ins
from tillsight.operators import labels as lab
from tillsight.operators import ranking
from tillsight.operators.ranking import rank_all
from tillsight.sources.tables import sales_view

SF = os.environ.get("PROPERTY_SF_DIR", "/root/testdata/sf0.001")
STORE = ["store_id"]


@pytest.fixture(scope="module")
def sales(spark):
    return sales_view(spark, SF)


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_item_units_equal_category_units(sales):
    items = agg.item_sums(sales, STORE, with_revenue=False).groupBy("store_id").agg(
        F.sum("qty_sum").alias("q"))
    cats = agg.category_list(sales, STORE, with_revenue=False).groupBy("store_id").agg(
        F.sum("qty_sum").alias("q"))
    diff = items.join(cats, "store_id", "full_outer").filter(
        ~F.coalesce(items.q == cats.q, F.lit(False)))
    assert diff.count() == 0


def test_category_shares_add_to_100(sales):
    tot = agg.category_share(sales, STORE).groupBy("store_id").agg(F.sum("share_pct").alias("s"))
    bad = tot.filter(F.abs(F.col("s") - 100.0) > 1e-6)
    assert tot.count() > 0 and bad.count() == 0


def test_rank_one_is_hot(sales):
    top = agg.top_items(sales, STORE, 5, with_revenue=True)
    tagged = lab.performance_tags(top, STORE, premium_price=5000.0)
    first = tagged.filter((F.col("rank") == 1) & (F.col("quantity") > 0))
    assert first.count() > 0
    assert first.filter(F.col("performance_tag.type") != "hot").count() == 0


def test_same_result_under_repartition(sales):
    shuffled = sales.repartition(7, F.col("row_key")).sortWithinPartitions(F.hash("row_key"))
    order = ["store_id", "rank"]
    a = _rows(agg.top_items(sales, STORE, 5), order)
    b = _rows(agg.top_items(shuffled, STORE, 5), order)
    assert a == b
    io = ["store_id", "seq"]
    a = _rows(ins.insights(sales, STORE, premium_price=5000.0), io)
    b = _rows(ins.insights(shuffled, STORE, premium_price=5000.0), io)
    assert a == b


def test_group_alone_equals_group_in_table(sales):
    store = sales.select(F.min("store_id")).first()[0]
    whole = agg.top_items(sales, STORE, 5).filter(F.col("store_id") == store)
    alone = agg.top_items(sales.filter(F.col("store_id") == store), STORE, 5)
    assert _rows(whole, ["rank"]) == _rows(alone, ["rank"])
    # the same group through the keyless path (the reference's one-export call)
    single = agg.top_items(sales.filter(F.col("store_id") == store), [], 5)
    cols = [c for c in whole.columns if c != "store_id"]
    assert _rows(whole.select(*cols), ["rank"]) == _rows(single.select(*cols), ["rank"])


def test_keyless_rank_matches_sort(sales):
    items = agg.item_list(sales, [], with_revenue=False)
    ranked = rank_all(items, [], [F.col("qty_sum").desc(), F.col("item_name").asc()])
    got = [(r["rank"], r["item_name"]) for r in ranked.orderBy("rank").collect()]
    rows = sorted(items.select("item_name", "qty_sum").collect(), key=lambda r: (-r["qty_sum"], r["item_name"]))
    assert got == [(i + 1, r["item_name"]) for i, r in enumerate(rows)]


def test_keyless_rank_at_many_partitions(spark):
    """No row is lost and no rank is wrong when the session has 200 shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(300_000).select(F.col("id"), (F.xxhash64("id") % 1000).alias("v"))
        ranked = rank_all(df, [], [F.col("v").desc(), F.col("id")])
        wrong = ranked.select("rank", "v", "id").toPandas().sort_values("rank")
        assert len(wrong) == 300_000 and list(wrong["rank"]) == list(range(1, 300_001))
        assert wrong.sort_values(["v", "id"], ascending=[False, True])["rank"].is_monotonic_increasing
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keyless_monthly_trend(sales):
    got = _rows(ins.monthly_trend(sales, [], max_months=2), ["month_rank"])
    mc = agg.month_category(sales, []).collect()
    months = sorted({r["month"] for r in mc})[:2]
    want = []
    for i, m in enumerate(months):
        best = sorted((r for r in mc if r["month"] == m), key=lambda r: (-r["quantity"], r["category"]))[0]
        want.append((i + 1, m, best["category"]))
    assert [(r[0], r[1], r[2]) for r in got] == want


def test_ranks_inside_a_huge_group_are_the_windows(spark, monkeypatch):
    """Groups over the bound are ranked range by range, in many tasks, as one window would."""
    rows = spark.range(0, 20_000, numPartitions=6).select(
        F.when(F.col("id") % 10 < 8, F.lit("big")).when(F.col("id") % 10 == 8, F.lit("small")).alias("g"), (F.hash("id") % 50).alias("q"),
        F.concat(F.lit("item "), F.col("id").cast("string")).alias("name"))
    order = [F.col("q").desc(), F.col("name")]
    plain = {tuple(r) for r in ranking.rank_all(rows, ["g"], order).collect()}
    monkeypatch.setattr(ranking, "GROUP_ROWS", 5_000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.rank_all(rows, ["g"], order)
        assert ranked.columns == ["g", "q", "name", "rank"] and {tuple(r) for r in ranked.collect()} == plain and len(plain) == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def _picks(sales):
    totals = sales.groupBy(*STORE).agg(
        F.max("quantity").alias("max_qty"), F.max("net_sales").alias("max_net"), F.max(ins.premium_quantity(15.0)).alias("max_prem"))
    return ins.row_picks(sales, totals, STORE)


def _pick_rows(spark, stores=40):
    """40 stores of 25 rows, some measures null, and rows without a store."""
    q = (F.col("id") * 7919 % 101).cast("decimal(18,4)")
    return spark.range(stores * 25).select(
        F.when(F.col("id") % 25 < 24, F.col("id") % stores).alias("store_id"), F.concat(F.lit("item "), F.col("id") % 9).alias("item_name"),
        F.when(F.col("id") % stores != 3, q).alias("quantity"), F.when(F.col("id") % 6 > 0, q * 3 + F.col("id") % 5).cast("decimal(18,4)").alias("net_sales"),
        (F.col("id") % 23).cast("decimal(18,6)").alias("avg_price"), F.struct("id").alias("row_key"))


def test_only_rows_near_a_peak_meet_the_peaks(spark, monkeypatch):
    """all sales used to be shuffled to meet the maxima of their groups as soon as these were too many to broadcast."""
    sales = _pick_rows(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        picks = _picks(sales)
        plan = picks._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
        got = _rows(picks, STORE)
        monkeypatch.setattr(ins, "PEAK_BUCKETS", 3)  # stores of a bucket share its bounds
        assert _rows(_picks(sales), STORE) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = [r for r in sales.collect() if r["store_id"] is not None]
    by = {r["store_id"]: r for r in map(lambda t: dict(zip(picks.columns, t)), got)}
    assert {r["store_id"] for r in rows} <= set(by)
    for store, pick in by.items():
        own = [r for r in rows if r["store_id"] == store]
        for name, measure, some in (("best", "quantity", own), ("top_rev", "net_sales", own), ("premium", "quantity", [r for r in own if r["avg_price"] > 15])):
            some = [r for r in some if r[measure] is not None]
            first = min(some, key=lambda r: (-r[measure], r["row_key"]["id"])) if some else None
            assert (pick[name] and (pick[name]["item_name"], pick[name][measure])) == (first and (first["item_name"], first[measure])), (store, name)


def test_gathered_sales_are_the_sales(spark, tmp_path):
    """prompts shuffled the sales for each of their sums; now a store's rows lie in one file and are summed there."""
    from tillsight.plans.catalog import _gathered_sales
    spark.range(600).selectExpr(
        "id div 4 AS l_orderkey", "id % 14 AS l_partkey", "IF(id % 50 = 0, NULL, id % 30) AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "id * 1.25D AS l_extendedprice", "0.05D AS l_discount",
        "timestamp_seconds(800000000 + id * 90000) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(12).selectExpr("id AS p_partkey", "concat('item ', id % 5) AS p_name", "concat('type ', id % 3) AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    sales = sales_view(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gathered = _gathered_sales(spark, str(tmp_path))
        assert gathered.dtypes == sales.dtypes
        assert gathered.exceptAll(sales).count() == 0 and sales.exceptAll(gathered).count() == 0
        files = gathered.select("store_id", F.input_file_name().alias("file")).distinct()
        assert files.select("file").distinct().count() > 1 and files.groupBy("store_id").count().filter("count > 1").count() == 0
        order = ["store_id", "seq"]
        assert _rows(ins.insights(gathered, STORE, gathered=True), order) == _rows(ins.insights(sales, STORE), order)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_large_sales_are_summed_slice_by_slice(spark, sales, monkeypatch):
    """every sum of large sales was shuffled after the rows were, and all shuffle files stayed until the end."""
    from tillsight import session
    from tillsight.operators import shared
    some = sales.withColumn("store_id", F.when(F.col("store_id") % 7 > 0, F.col("store_id")))  # stores without a number too
    parts = lambda: {p: _rows(t, t.columns) for p, t in shared.shared_sums(some, STORE).items()}
    sums, notes = parts(), _rows(ins.insights(some, STORE, premium_price=5000.0), ["store_id", "seq"])
    rows = some.select(*STORE, "item_name", "quantity")
    by_store = shared._expanded(rows, STORE, ["item_name"], [shared.TOTAL, shared.ITEM]).groupBy(*STORE, "item_name", "part").sum("quantity")
    assert by_store._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(session, "SLICE_BYTES", 1)
    monkeypatch.setattr(session, "MAX_SLICES", 2)
    assert session.slice_count(some) == 2 and parts() == sums
    assert _rows(ins.insights(some, STORE, premium_price=5000.0), ["store_id", "seq"]) == notes and len(notes) > 10
    monkeypatch.setattr(shared, "GROUP_ROWS", 3)  # a store too large for a task
    assert not shared._all_small(some, STORE) and parts() == sums

"""Streaming compare (T2) per micro-batch: a replayed batch changes nothing,
and the streamed panels equal the batch compare of the same uploads
(SURVEY §5 item 5)."""

import datetime
import random
import tempfile

from pyspark.sql import functions as F

from tillsight.operators import compare as cmp
from tillsight.sources.tables import sales_view
from tillsight.streaming import dropfolder
from tillsight.streaming.dropfolder import compare_batch, latest_panels

SF = "/root/testdata/sf0.001"
STORE = ["store_id"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replayed_batch_changes_nothing(spark):
    s = sales_view(spark, SF).select("store_id", "period", "item_name", "quantity")
    first = s.filter(F.col("period") <= 1995)
    second = s.filter(F.col("period") > 1995)
    base = tempfile.mkdtemp(prefix="tillsight-stream-")
    snap, panels = f"{base}/snapshot", f"{base}/panels"

    compare_batch(spark, first, 0, snap, panels, STORE, "period")
    compare_batch(spark, second, 1, snap, panels, STORE, "period")
    old1 = _rows(spark.read.parquet(f"{panels}/old/batch_id=1"))
    new1 = _rows(spark.read.parquet(f"{panels}/new/batch_id=1"))
    snap1 = _rows(spark.read.parquet(f"{snap}/items"))
    assert old1 and new1

    # the same batch again (an attempt retried after a failure)
    compare_batch(spark, second, 1, snap, panels, STORE, "period")
    assert _rows(spark.read.parquet(f"{panels}/old/batch_id=1")) == old1
    assert _rows(spark.read.parquet(f"{panels}/new/batch_id=1")) == new1
    assert _rows(spark.read.parquet(f"{snap}/items")) == snap1

    # streamed panels of both batches = batch compare over all uploads
    pairs = cmp.successive_pairs(s, STORE, "period")
    want_old, want_new = cmp.top_panels(s, pairs, STORE, "period", 5)
    got_old = latest_panels(spark, panels, STORE, "old")
    got_new = latest_panels(spark, panels, STORE, "new")
    assert _rows(got_old.select(*want_old.columns)) == _rows(want_old)
    assert _rows(got_new.select(*want_new.columns)) == _rows(want_new)


UPLOADS = "store_id long, period int, item_name string, quantity double"


def _uploads(spark, rows):
    return spark.createDataFrame(rows, UPLOADS).withColumn("quantity", F.col("quantity").cast("decimal(18,4)"))


def _folders():
    base = tempfile.mkdtemp(prefix="tillsight-stream-")
    return f"{base}/snapshot", f"{base}/panels"


def test_upload_split_over_batches_gives_one_panel(spark):
    s = _uploads(spark, [(1, 1, "A", 10.0), (1, 1, "B", 5.0), (1, 2, "A", 2.0), (1, 2, "A", 18.0), (1, 2, "C", 1.0), (1, 3, "A", 5.0), (2, 1, "X", 1.0)])
    snap, panels = _folders()
    parts = [s.filter("period = 1 or (period = 2 and quantity = 2)"), s.filter("period = 2 and quantity <> 2"), s.filter("period = 3")]
    for i, part in enumerate(parts):  # the middle upload comes in two pieces
        compare_batch(spark, part, i, snap, panels, STORE, "period")
    want, _ = cmp.top_panels(s, cmp.successive_pairs(s, STORE, "period"), STORE, "period", 5)
    assert _rows(latest_panels(spark, panels, STORE).select(*want.columns)) == _rows(want)


def test_a_late_upload_moves_nothing(spark):
    s = _uploads(spark, [(1, 1, "A", 10.0), (1, 3, "A", 7.0), (2, 1, "X", 4.0), (2, 2, "X", 5.0)])
    snap, panels = _folders()
    compare_batch(spark, s, 0, snap, panels, STORE, "period")
    before = _rows(latest_panels(spark, panels, STORE).drop("batch_id"))
    # upload 2 is older than the store's last one, and so are more rows of upload 1; another store goes on in the same batch
    late = _uploads(spark, [(1, 2, "B", 99.0), (1, 1, "B", 50.0), (2, 3, "X", 6.0)])
    compare_batch(spark, late, 1, snap, panels, STORE, "period")
    after = _rows(latest_panels(spark, panels, STORE).drop("batch_id"))
    assert [r for r in after if r[0] == 1] == [r for r in before if r[0] == 1] and len(after) == len(before) + 1
    compare_batch(spark, _uploads(spark, [(1, 4, "A", 9.0)]), 2, snap, panels, STORE, "period")
    panel = [r for r in latest_panels(spark, panels, STORE).filter("store_id = 1 and curr_upload = 4").collect()]
    assert [(r.prev_upload, r.item_name, r.prev_qty, r.curr_qty) for r in panel] == [(3, "A", 7, 9)]


def test_a_batch_writes_the_stores_it_touches(spark, monkeypatch):
    monkeypatch.setattr(dropfolder, "INDEX_EVERY", 4)
    rows = [(s, 1, f"item {k}", 1.0 + k) for s in range(300) for k in range(20)]
    snap, panels = _folders()
    compare_batch(spark, _uploads(spark, rows), 0, snap, panels, STORE, "period")
    for batch in range(1, 10):
        compare_batch(spark, _uploads(spark, [(7, batch + 1, "item 3", 5.0), (batch + 100, 2, "item 4", 5.0)]), batch, snap, panels, STORE, "period")
        state = spark.read.parquet(f"{snap}/items/batch_id={batch}")
        assert sorted(r.store_id for r in state.select("store_id").distinct().collect()) == [7, batch + 100]
        assert state.filter("store_id = 7 and kept").select("period").distinct().count() == 2  # and no older ones
        index = spark.read.parquet(f"{snap}/index/batch_id={batch}").count()
        assert index == (300 if batch % 4 == 0 else 2)  # whole every fourth batch
    heads = {r.store_id: (r.head, r["at"]) for r in dropfolder.state_index(spark, snap, STORE, 10).collect()}
    assert len(heads) == 300 and heads[7] == (10, 9) and heads[101] == (2, 1) and heads[5] == (1, 0)
    # what no store needs goes, what one still needs stays, and the next batch finds its state
    with_one_more = [(b, 3, "item 4", 1.0) for b in range(101, 106)]
    compare_batch(spark, _uploads(spark, with_one_more), 10, snap, panels, STORE, "period")
    assert dropfolder.clean_state(spark, snap, STORE, 11) == [1, 2, 3, 4, 5]
    assert dropfolder.list_names(spark, f"{snap}/index") == [f"batch_id={n}" for n in (10, 8, 9)]
    compare_batch(spark, _uploads(spark, [(106, 3, "item 9", 1.0), (5, 2, "item 0", 3.0)]), 11, snap, panels, STORE, "period")
    done = latest_panels(spark, panels, STORE)
    assert {r.item_name for r in done.filter("store_id = 5").collect()} == {f"item {k}" for k in range(15, 20)}
    assert [r.prev_qty for r in done.filter("store_id = 106 and curr_upload = 3").collect()] == [5]


EVENTS = "request_id long, seq long, ts timestamp, status string, partial long"


def _at(day, hour=0):
    return datetime.datetime(2025, 1, day, hour)


class _Drops:
    """A folder into which rows are dropped, and a stream that is run after each drop."""

    def __init__(self, spark, schema, run):
        self.spark, self.schema, self.run, self.n = spark, schema, run, 0
        self.base = tempfile.mkdtemp(prefix="tillsight-stream-")

    def __call__(self, rows):
        """The operator's state rows and rows dropped as late, over the batches of this run."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.base}/drop/{self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/drop")
        q = self.run(stream, f"{self.base}/out", f"{self.base}/checkpoint")
        state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        return state[-1]["numRowsTotal"], sum(x["numRowsDroppedByWatermark"] for x in state)

    def out(self):
        return self.spark.read.option("recursiveFileLookup", "false").parquet(f"{self.base}/out")


def test_status_drops_late_events_and_forgets_silent_requests(spark):
    drop = _Drops(spark, EVENTS, lambda s, out, ckpt: dropfolder.status_stream(
        s, out, ckpt, "request_id", ["ts", "seq"], "ts", ["seq", "status", "partial", "ts"], late="1 hour", idle="2 days"))
    big = 2**53 + 1  # beyond a double
    assert drop([(k, 1, _at(1), "connecting", None) for k in range(10)] + [(0, 2, _at(1, 2), "streaming", big)]) == (10, 0)
    kept, late = drop([(0, 3, _at(2), "streaming", 9), (1, 0, _at(1, 12), "generating", None), (2, 9, _at(1, 0), "late", None)])
    assert late == 1 and kept == 10  # two hours behind the watermark's hour
    state, late = drop([(50, 1, _at(9), "connecting", None), (0, 4, _at(2), "late", None)])
    assert late == 0 or state <= 11
    state, late = drop([(50, 2, _at(9, 1), "complete", 5), (0, 5, _at(1), "late", None)])
    assert late == 1 and state == 1  # all others have been silent for over two days
    last = {r.request_id: r for r in dropfolder._latest(drop.out(), ["request_id"]).collect()}
    assert (last[0].n_events, last[0].seq, last[0].partial) in ((3, 3, 9), (4, 4, None)) and (last[1].n_events, last[1].status) == (2, "generating")
    assert (last[2].n_events, last[2].status) == (1, "connecting") and (last[50].n_events, last[50].status, last[50].partial) == (2, "complete", 5)
    first = drop.out().filter("batch_id = 0 and request_id = 0").first()
    assert (first.n_events, first.partial, first.ts) == (2, big, _at(1, 2))


CHUNKS = "reply long, seq int, role string, text string, at timestamp"


def test_progress_of_shuffled_chunks_is_the_batch_result(spark):
    rng = random.Random(3)
    rows = [(r, k, rng.choice(["a", None]), rng.choice([None, "", "x" * rng.randint(1, 30)]), _at(1) + datetime.timedelta(seconds=k)) for r in range(12) for k in range(25)]
    want = {(x[0], x[1]): (x[2], sum(len(y[3] or "") for y in rows if y[0] == x[0] and y[1] <= x[1])) for x in rows}
    rng.shuffle(rows)
    drop = _Drops(spark, CHUNKS, lambda s, out, ckpt: dropfolder.progress_stream(s, out, ckpt, "reply", "seq", "at", late="1 hour"))
    for k in range(0, len(rows), 75):
        drop(rows[k : k + 75] + rows[max(0, k - 5) : k])  # the last five come again
    got = drop.out().collect()
    assert len(got) == len(rows) and {(r.reply, r.seq): (r.role, r.partial) for r in got} == want


def test_progress_gives_up_gaps_and_ends(spark):
    drop = _Drops(spark, CHUNKS, lambda s, out, ckpt: dropfolder.progress_stream(s, out, ckpt, "reply", "seq", "at", late="1 hour", idle="1 day"))
    drop([(1, 0, "u", "ab", _at(1)), (1, 2, "u", "cdef", _at(1, 1)), (2, 0, "u", "x", _at(1))])
    partials = lambda: sorted((r.reply, r.seq, r.partial) for r in drop.out().collect())
    assert partials() == [(1, 0, 2), (2, 0, 1)]  # chunk 2 waits for chunk 1
    drop([(3, 0, "u", "y", _at(1, 8))])
    drop([(3, 1, "u", "y", _at(1, 9))])
    assert (1, 2, 6) in partials()  # the watermark has passed it
    drop([(4, 0, "u", "z", _at(20))])
    state, late = drop([(4, 1, "u", "z", _at(20, 1)), (1, 3, "u", "late", _at(1, 2))])
    assert late == 1 and state == 1
    assert partials() == [(1, 0, 2), (1, 2, 6), (2, 0, 1), (3, 0, 1), (3, 1, 2), (4, 0, 1), (4, 1, 2)]


def test_many_small_exports_are_one_batch(spark):
    """a batch used to be 200 files, so the number of ingests grew with the files."""
    import os
    src, out = tempfile.mkdtemp(prefix="tillsight-drop-"), tempfile.mkdtemp(prefix="tillsight-out-")
    for i in range(205):
        with open(os.path.join(src, f"s{i}.csv"), "w") as f:
            f.write("\n" if i == 7 else f"category,item_name,quantity\nFood,Tea,{i}\n")
    dropfolder.ingest_stream(spark, src, out, tempfile.mkdtemp(prefix="tillsight-ckpt-"))
    got = spark.read.parquet(f"{out}/sales").select("batch_id", "quantity").collect()
    assert {r["batch_id"] for r in got} == {0} and sorted(int(r["quantity"]) for r in got) == [i for i in range(205) if i != 7]
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert [(r["upload_id"].rsplit("/", 1)[1], r["error"]) for r in rejects] == [("s7.csv", "No columns to parse from file")]


def test_rows_of_a_group_meet_before_they_are_expanded(spark):
    """Rows used to be expanded where they lay, and four rows were shuffled for each."""
    from tillsight.operators.shared import together
    rows = spark.range(8).selectExpr("id % 2 AS store_id", "id")
    assert "RebalancePartitions" in together(rows, STORE)._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(together(rows, STORE)) == _rows(rows) and together(rows, []) is rows


def test_a_part_of_the_sums_is_a_folder_of_its_own(spark):
    """The size of the totals used to be taken for that of all sums, and all sales were shuffled to meet them."""
    from tillsight.operators.shared import ITEM, TOTAL, part_of, shared_sums
    s = sales_view(spark, SF)
    sums = shared_sums(s, STORE)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(part_of(sums, TOTAL)) < size(part_of(sums, ITEM))
    assert part_of(sums, TOTAL).count() == s.select(*STORE).distinct().count()
    assert part_of(shared_sums(s.limit(0), STORE), TOTAL).count() == 0  # no row, no folder


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """a task read a handful of small files, and wrote a file of lines for them."""
    from tillsight.session import few_tasks
    from tillsight.sources.exports import read_export_lines
    for i in range(3 * few_tasks(spark)):
        (tmp_path / f"{i}.csv").write_text(f"Item Name,Quantity\nTea,{i}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a file a task
    try:
        lines = read_export_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() <= few_tasks(spark)
        got = sorted((r["upload_id"], r["pos"]["block"], r["pos"]["off"], r["line"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 6 * few_tasks(spark) and [g[3] for g in got[::2]] == ["Item Name,Quantity"] * (len(got) // 2)
    assert {g[3] for g in got[1::2]} == {f"Tea,{i}" for i in range(len(got) // 2)}

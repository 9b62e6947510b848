"""Structured Streaming over a drop folder (T1, T2, S11) and over reply streams.

T1: every new export file is ingested as it lands and its typed rows are written.  The
stream only carries names; the files of a micro-batch are read by the splittable line reader.  An ingest is some dozens of
jobs however few files it has, so a micro-batch takes as many as the driver can well name.

T2: every micro-batch of sales rows is compared with each store's previous upload.  The state of a
store is the item totals of its last two uploads; a batch reads the state of the stores that it has rows of, and
writes theirs anew under its own ``batch_id``, with an index of which batch holds which store.  So what a batch writes
follows the stores it touches, a replayed batch writes the same files again, and an upload that arrives in
several batches is one upload while it is the last.  Rows of an upload older than the store's last one come too late: T1
has written them, the compare does not move.  ``latest_panels`` gives each upload's panel from the last batch that changed it.

``summary_stream`` puts them together: after each upload one document with its summary (A23) and the panels against the upload
before, published as a version of its own (S11).

T3, T4: the latest status of each request, and the running length of each reply, as keyed state with event-time
timers.  Events behind the watermark are dropped, and a key that has been silent for ``idle`` is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import compare as cmp
from ..operators.shared import shared_sums
from ..plans.summary import summary_document
from ..session import few_tasks, write_lean
from ..sources import exports as ex
from ..sources import published
from ..sources.published import delete_path, list_names

BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
#: Files that a micro-batch of the ingest takes at most: their names, some 100 bytes each, pass through the driver.
FILES_PER_BATCH = 20_000
LOOKUP_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Every so many batches the index of the compare state is written whole; readers begin at the last whole one.
INDEX_EVERY = 64


def ingest_stream(spark: SparkSession, src: str, out: str, checkpoint: str,
                  glob: str = "*.csv", files_per_batch: int = FILES_PER_BATCH, variant: ex.Variant = ex.BACKEND):
    """Drop-folder ingest; returns the finished ``StreamingQuery``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(src).select("path"))

    def batch(df: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in df.coalesce(few_tasks(spark)).collect()]  # at most files_per_batch names
        if not paths:
            return
        names = spark.createDataFrame([(p,) for p in paths], "upload_id string")
        res = ex.ingest_exports(spark, paths, glob, variant, names)
        write_lean(res.sales, f"{out}/sales/batch_id={batch_id}", mode="overwrite")
        write_lean(res.rejects, f"{out}/rejects/batch_id={batch_id}", mode="overwrite")

    # files are looked up by name in few tasks; Spark starts up to 10,000, one for a name or two
    lookups = spark.conf.get(LOOKUP_TASKS)
    spark.conf.set(LOOKUP_TASKS, str(few_tasks(spark)))
    try:
        q = (files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(LOOKUP_TASKS, lookups)
    return q


def item_totals(sales: DataFrame, group_cols: Sequence[str], upload_col: str) -> DataFrame:
    """Item quantities per upload: the state a later upload is compared with."""
    return sales.groupBy(*group_cols, upload_col, "item_name").agg(
        F.sum("quantity").cast("decimal(28,4)").alias("quantity"))


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no batch has written yet
        return None


def _latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the last batch that wrote each key."""
    last = table.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return table.join(last, [*keys, "batch_id"], "left_semi")


def state_index(spark: SparkSession, snapshot: str, group_cols: Sequence[str], before: int) -> DataFrame | None:
    """(group, head, at): each store's last upload and the batch that holds its state, as of the batches before one.
    A replayed batch does not see what its own failed attempt wrote."""
    index = _read_if_there(spark, f"{snapshot}/index")
    if index is None or before <= 0:
        return None
    whole = (before - 1) // INDEX_EVERY * INDEX_EVERY
    return _latest(index.filter((F.col("batch_id") >= whole) & (F.col("batch_id") < before)), group_cols).drop("batch_id")


def compare_batch(spark: SparkSession, batch: DataFrame, batch_id: int, snapshot: str, panels: str,
                  group_cols: Sequence[str], upload_col: str, top_n: int = 5) -> None:
    """T2 for one micro-batch: the uploads that it brings or adds to are compared with the ones before them."""
    group_cols = list(group_cols)
    fresh = item_totals(batch, group_cols, upload_col)
    index = state_index(spark, snapshot, group_cols, batch_id)
    both = fresh.withColumn("fresh", F.lit(True))
    if index is not None:
        heads = index.join(batch.select(*group_cols).distinct(), group_cols, "left_semi")
        # late: older than the store's last upload
        both = both.join(heads, group_cols, "left").filter(F.col("head").isNull() | (F.col(upload_col) >= F.col("head"))).drop("head", "at")
        held = [r["at"] for r in heads.select("at").distinct().collect()]  # numbers of batches
        if held:
            items = spark.read.parquet(f"{snapshot}/items").filter(F.col("batch_id").isin(held) & F.col("kept"))
            mine = heads.join(both.select(*group_cols).distinct(), group_cols, "left_semi").withColumnRenamed("at", "batch_id")
            old = items.join(mine.drop("head"), [*group_cols, "batch_id"], "left_semi")
            both = both.unionByName(old.select(*fresh.columns).withColumn("fresh", F.lit(False)))
    totals = both.groupBy(*group_cols, upload_col, "item_name").agg(
        F.sum("quantity").cast("decimal(28,4)").alias("quantity"), F.bool_or("fresh").alias("fresh"))
    uploads = totals.groupBy(*group_cols, upload_col).agg(F.bool_or("fresh").alias("is_new"))
    back = F.row_number().over(Window.partitionBy(*group_cols).orderBy(F.col(upload_col).desc()))
    uploads = uploads.withColumn("kept", back <= 2)  # over uploads of the state and the batch, not over rows
    state = totals.drop("fresh").join(uploads, [*group_cols, upload_col])
    write_lean(state.sortWithinPartitions(*group_cols), f"{snapshot}/items/batch_id={batch_id}", mode="overwrite")
    state = spark.read.parquet(f"{snapshot}/items/batch_id={batch_id}")

    new = state.filter("is_new").select(*group_cols, F.col(upload_col).alias("curr_upload")).distinct()
    pairs = cmp.successive_pairs(state, group_cols, upload_col).join(new, [*group_cols, "curr_upload"], "left_semi")
    old, new = cmp.top_panels(state, pairs, group_cols, upload_col, top_n)
    write_lean(old, f"{panels}/old/batch_id={batch_id}", mode="overwrite")
    write_lean(new, f"{panels}/new/batch_id={batch_id}", mode="overwrite")
    heads = state.groupBy(*group_cols).agg(F.max(upload_col).alias("head")).withColumn("at", F.lit(batch_id).cast("bigint"))
    if batch_id % INDEX_EVERY == 0 and index is not None:
        heads = heads.unionByName(index.select(*heads.columns).join(heads, group_cols, "left_anti"))
    write_lean(heads, f"{snapshot}/index/batch_id={batch_id}", mode="overwrite")  # last: the batch counts from here on


def clean_state(spark: SparkSession, snapshot: str, group_cols: Sequence[str], batch_id: int) -> list[int]:
    """Deletes the state of batches before ``batch_id`` that no store needs, and index parts before the last whole one; the batch itself
    may be replayed, so what it reads stays.  Returns the batches whose state went."""
    index = state_index(spark, snapshot, group_cols, batch_id)
    if index is None:
        return []
    needed = {r["at"] for r in index.select("at").distinct().collect()}
    number = lambda name: int(name.split("=")[1])
    gone = [n for n in map(number, list_names(spark, f"{snapshot}/items")) if n < batch_id and n not in needed]
    for n in gone:
        delete_path(spark, f"{snapshot}/items/batch_id={n}")
    for n in map(number, list_names(spark, f"{snapshot}/index")):
        if n < (batch_id - 1) // INDEX_EVERY * INDEX_EVERY:
            delete_path(spark, f"{snapshot}/index/batch_id={n}")
    return sorted(gone)


def latest_panels(spark: SparkSession, panels: str, group_cols: Sequence[str], side: str = "old") -> DataFrame:
    """One panel per upload: from the last batch that changed the upload."""
    return _latest(spark.read.parquet(f"{panels}/{side}"), [*group_cols, "curr_upload"]).drop("batch_id")


def compare_stream(spark: SparkSession, src: str, schema, snapshot: str, panels: str, checkpoint: str,
                   group_cols: Sequence[str], upload_col: str, top_n: int = 5):
    """Stream typed sales files (parquet) and compare every upload with
    its predecessor; returns the finished ``StreamingQuery``."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)

    def step(df: DataFrame, batch_id: int) -> None:
        compare_batch(spark, df, batch_id, snapshot, panels, group_cols, upload_col, top_n)
        if batch_id % INDEX_EVERY == INDEX_EVERY - 1:
            clean_state(spark, snapshot, group_cols, batch_id)

    q = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


OLD_PANEL = ("prev_rank", "item_name", "prev_qty", "curr_qty", "pct_change", "status")
NEW_PANEL = ("curr_rank", "item_name", "curr_qty")


def _nested_panel(panel: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """A panel's rows, at most N, as one array an upload."""
    return panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def summary_batch(spark: SparkSession, batch: DataFrame, batch_id: int, base: str, group_cols: Sequence[str], upload_col: str, top_n: int = 5,
                  **how) -> published.Version:
    """Rows of one micro-batch -> the documents of the uploads that it brings or adds to, each with its summary and its panels;
    uploads without one before them have none.  Published under the batch's number, so a replayed batch changes nothing."""
    keys = [*group_cols, upload_col]
    write_lean(batch, f"{base}/sales/batch_id={batch_id}", mode="overwrite")
    rows = spark.read.parquet(f"{base}/sales").filter(F.col("batch_id") <= batch_id).drop("batch_id")
    mine = spark.read.parquet(f"{base}/sales/batch_id={batch_id}")
    touched = mine.select(*keys).distinct()
    compare_batch(spark, mine, batch_id, f"{base}/snapshot", f"{base}/panels", group_cols, upload_col, top_n)
    mine = rows.join(touched, keys, "left_semi")
    sums = shared_sums(mine, keys, how.get("premium_price", 15.0), how.get("flags"))
    doc = summary_document(mine, keys, top_n=top_n, sums=sums, **how)
    for side, fields, name in (("old", OLD_PANEL, "previous_panel"), ("new", NEW_PANEL, "current_panel")):
        panel = spark.read.parquet(f"{base}/panels/{side}/batch_id={batch_id}").withColumnRenamed("curr_upload", upload_col)
        doc = doc.join(_nested_panel(panel, keys, fields, name), keys, "left")
    version = published.publish(spark, f"{base}/summaries", {"summary": doc}, number=batch_id)
    sums.drop(spark, *sums)
    return version


def summary_stream(spark: SparkSession, src: str, schema, base: str, checkpoint: str, group_cols: Sequence[str], upload_col: str, top_n: int = 5, **how):
    """Typed sales files (parquet) -> a version of documents for each micro-batch; returns the finished ``StreamingQuery``."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    q = (rows.writeStream.foreachBatch(lambda df, bid: summary_batch(spark, df, bid, base, group_cols, upload_col, top_n, **how) and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_summaries(spark: SparkSession, base: str, keys: Sequence[str]) -> DataFrame:
    """Each upload's document, from the last version that has it."""
    return _latest(published.read_all(spark, f"{base}/summaries", "summary", "batch_id"), keys).drop("batch_id")


def _write_updates(stream: DataFrame, out: str, checkpoint: str):
    """Each batch's updates under its own number; a replayed batch writes the same files again."""
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda df, bid: df.write.mode("overwrite").parquet(f"{out}/batch_id={bid}")).start())
    q.awaitTermination()
    return q


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1ms"))


def _sortable(df: DataFrame, name: str) -> Column:
    """A number or time as a long, null first; the state of a key holds longs and texts only."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("timestamp"):
        value = F.unix_micros(F.col(name).cast("timestamp"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.col(name).cast("bigint")
    else:
        raise ValueError(f"{name}: events are put in order by whole numbers and timestamps, not by {kind}")
    return F.coalesce(value, F.lit(-(1 << 63)))


def _unpacked(df: DataFrame, schema: StructType, names: Sequence[str], others: Sequence[str]) -> DataFrame:
    """The columns that were packed as JSON, behind the others."""
    packed = StructType([schema[c] for c in names])
    return df.withColumn("_v", F.from_json("_values", packed)).select(*others, *[F.col("_v").getField(c).alias(c) for c in names])


def status_stream(events: DataFrame, out: str, checkpoint: str, key: str, order_cols: Sequence[str], event_time: str,
                  value_cols: Sequence[str], late: str = "1 hour", idle: str = "1 day"):
    """The latest event of every request, in update mode; returns the finished query.

    Events more than ``late`` behind the newest are dropped.  The state of a request (a count, the latest event's order and
    values) goes when the watermark is ``idle`` past its newest event; an event after that begins the request anew."""
    order = [f"_o{i}" for i in range(len(order_cols))]
    rows = events.withWatermark(event_time, late).select(
        key, event_time, F.coalesce(F.unix_millis(F.col(event_time).cast("timestamp")), F.lit(0)).alias("_at"),
        *[_sortable(events, c).alias(o) for c, o in zip(order_cols, order)], F.to_json(F.struct(*value_cols)).alias("_values"))
    rest = _milliseconds(idle)

    def follow(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, at, best, values = (state.get[0], state.get[1], tuple(state.get[2:-1]), state.get[-1]) if state.exists else (0, 0, None, None)
        for pdf in frames:
            n, at = n + len(pdf), max(at, int(pdf["_at"].max()))
            last = pdf.sort_values(order, kind="stable").iloc[-1]
            mine = tuple(int(last[o]) for o in order)
            if best is None or mine >= best:
                best, values = mine, last["_values"]
        state.update((n, at, *best, values))
        state.setTimeoutTimestamp(max(at + rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]], "n_events": [n], "_values": [values]})

    kind = events.schema[key].dataType.simpleString()
    kept = "n long, at long, " + ", ".join(f"{o} long" for o in order) + ", vals string"
    updates = rows.groupBy(key).applyInPandasWithState(
        follow, f"`{key}` {kind}, n_events long, _values string", kept, "update", GroupStateTimeout.EventTimeTimeout)
    return _write_updates(_unpacked(updates, events.schema, [c for c in value_cols if c != key], [key, "n_events"]), out, checkpoint)


def progress_stream(chunks: DataFrame, out: str, checkpoint: str, key: str, order: str, event_time: str, text_col: str = "text",
                    first: int = 0, late: str = "1 hour", idle: str = "1 day"):
    """T4: running reply length after every chunk; returns the finished query.

    Chunks are numbered from ``first`` and may arrive in any order, over any batches.  A chunk is counted once all before it
    are; one that came early waits in the state.  When the watermark has passed a waiting chunk, what is missing before it would be dropped
    as late, so the gap is given up and the chunk counted.  A number that came before is a repeat and ignored.  A reply's state (two
    numbers and the chunks that wait) goes when the watermark is ``idle`` past its newest chunk."""
    kept_cols = [c for c in chunks.columns if c != text_col]
    rows = chunks.withWatermark(event_time, late).select(
        key, event_time, F.coalesce(F.unix_millis(F.col(event_time).cast("timestamp")), F.lit(0)).alias("_at"), _sortable(chunks, order).alias("_o"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("_n"), F.to_json(F.struct(*kept_cols)).alias("_values"))
    rest = _milliseconds(idle)

    def grow(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ahead, total, at, waiting = (*state.get[:3], json.loads(state.get[3])) if state.exists else (first, 0, 0, [])
        if state.hasTimedOut and not waiting:
            state.remove()
            return
        known = {w[0] for w in waiting}
        if not state.hasTimedOut:
            for pdf in frames:
                for o, n, ms, values in zip(pdf["_o"].tolist(), pdf["_n"].tolist(), pdf["_at"].tolist(), pdf["_values"]):
                    at = max(at, ms)
                    if o >= ahead and o not in known:
                        known.add(o)
                        waiting.append([o, n, ms, values])
        waiting.sort(key=lambda w: w[0])
        mark = state.getCurrentWatermarkMs()
        sure = max((w[0] for w in waiting if w[2] <= mark), default=ahead)  # nothing before it can come any more
        done = 0
        out = []
        while done < len(waiting) and (waiting[done][0] == ahead or waiting[done][0] <= sure):
            o, n, _, values = waiting[done]
            ahead, total, done = o + 1, total + n, done + 1
            out.append((total, values))
        waiting = waiting[done:]
        state.update((ahead, total, at, json.dumps(waiting)))
        state.setTimeoutTimestamp(max(min((w[2] for w in waiting), default=at + rest), mark + 1))
        if out:
            yield pd.DataFrame({"partial": [t for t, _ in out], "_values": [v for _, v in out]})

    counted = rows.groupBy(key).applyInPandasWithState(
        grow, "partial long, _values string", "ahead long, total long, at long, waiting string", "update", GroupStateTimeout.EventTimeTimeout)
    return _write_updates(_unpacked(counted, chunks.schema, kept_cols, ["partial"]).select(*kept_cols, "partial"), out, checkpoint)

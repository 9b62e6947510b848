"""Repeated passages of words, found on a de Bruijn graph of token k-mers.

Nodes are k-mers of words, taken where they are the least k-mer of some window of
``WINDOW`` words, so every window has one; an edge is the words from one node of a
document to its next one.  Where all occurrences of a node go on by one and the same edge, and all
occurrences of the next node come from it, the path does not branch and the two are
compacted.  A chain of compacted nodes that occurs twice at all occurs twice as a whole.

1. Documents are dealt into chunks of some MB.  A chunk sends its distinct nodes, with their
   edges to the right and left, to buckets of node hashes (``buckets``).
2. A bucket joins the occurrences of each node: does it repeat, and is its edge to the right, or
   to the left, the same everywhere?
3. The answers are co-grouped with the chunks they belong to: back at the source coordinates,
   neighbouring nodes are compacted into chains, and chains are spans that surely repeat.
   Windows that hold a repeated node but don't lie within one chain, at ends and branches, are
   verified by themselves: 128-bit hashes of their words go to buckets, which count them.
   (A window inside a chain is inside it wherever it occurs, so the two kinds never have
   to be compared.)
4. Every word of a repeated window is removed.

Chunks and buckets have a fixed mean size, their number grows with the data.  Text is shuffled
once: the chunks are read three times from the same shuffle.

Defined cases: null text has no words; documents of fewer words than a window keep them
all.  Each row is a document of its own: rows that repeat an id and text repeat each
other.  Null ids are ids like any other.  Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.buckets import ANSWER, LOW, SENT, SENT_TYPE, answered, answers_for, bucketed, joined, slices, table
from tillsight.llm.windows import BASES, RangeHash, anchors, mixed

WINDOW = 35
NODE = 8
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
REPEATED, RIGHT, LEFT = 1, 2, 4
U = np.uint64


#: A fixed number for each byte, and whether it is white space.
BYTES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a column as one byte array; where each starts and ends.  Null is empty."""
    texts = column.combine_chunks().cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges[:-1] - edges[0], edges[1:] - edges[0]


class Graph:
    """The documents of a chunk as one sequence of words, and its nodes."""

    def __init__(self, texts: pa.ChunkedArray, window: int, node: int, buckets: int):
        self.window, self.node, self.buckets = window, node, buckets
        self.data, self.from_byte, self.to_byte = text_bytes(texts)
        inside = ~SPACE[self.data]
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        before[self.from_byte[self.from_byte < len(inside)]] = False  # words end with their document
        begin = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        last = self.to_byte[self.to_byte > self.from_byte] - 1
        after[last] = False
        end = np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(self.to_byte, begin, side="right")
        self.n = len(begin)
        count = np.bincount(doc, minlength=len(self.to_byte))
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        self.values = RangeHash(BYTES[self.data])(begin, end)
        self.hash = RangeHash(self.values)
        grams = self.hash.fixed(node) if self.n >= node else np.zeros(0, U)
        of_window = anchors(grams, window - node + 1)
        self.windows = np.flatnonzero(np.arange(len(of_window)) + window <= self.ends[doc[: len(of_window)]])  # within one document
        self.at, self.of_window = np.unique(of_window[self.windows], return_inverse=True)  # places of the nodes
        beside = doc[self.at[:-1]] == doc[self.at[1:]] if len(self.at) else np.zeros(0, bool)
        edge = np.where(beside, self.hash(self.at[:-1], self.at[1:] + node) | U(1), U(0)) if len(self.at) else np.zeros(0, U)
        none = np.zeros(min(1, len(self.at)), U)  # 0: an end of the document
        self.beside, self.right, self.left = beside, np.concatenate([edge, none]), np.concatenate([none, edge])
        self.codes, self.code_of = np.unique(bucketed(mixed(grams[self.at]), buckets), return_inverse=True)

    def nodes(self):
        """Of each distinct node: whether it repeats here, and its only edge to either side, 0 if it has none such."""
        count = np.bincount(self.code_of, minlength=len(self.codes))
        sides = []
        for edge in (self.right, self.left):
            low, high = np.full(len(self.codes), np.iinfo(U).max, U), np.zeros(len(self.codes), U)
            np.minimum.at(low, self.code_of, edge)
            np.maximum.at(high, self.code_of, edge)
            sides.append(np.where(low == high, low, U(0)))
        return count > 1, *sides

    def pieces(self, ways: np.ndarray) -> None:
        """From the answers about the nodes: windows that surely repeat, and windows to verify."""
        way = ways[self.code_of]
        repeated = way & REPEATED > 0
        linked = self.beside & repeated[:-1] & repeated[1:] & (way[:-1] & RIGHT > 0) & (way[1:] & LEFT > 0) if len(way) else self.beside
        chain = np.concatenate([[0], np.cumsum(~linked)])
        m, starts = len(self.at), self.windows
        first = np.searchsorted(self.at, starts, side="right") - 1
        last = np.searchsorted(self.at, starts + self.window - self.node, side="left")
        inner = (first >= 0) & (last < m)
        f, e = np.maximum(first, 0), np.minimum(last, max(m - 1, 0))
        sure = inner & repeated[f] & repeated[e] & (chain[f] == chain[e]) if m else inner
        self.sure = starts[sure]
        self.check = starts[repeated[self.of_window] & ~sure] if m else starts
        h1, h2 = (h(self.check, self.check + self.window) for h in (self.hash, RangeHash(self.values, BASES[1])))
        code = bucketed(mixed(h1), self.buckets) >> U(32)
        order = np.lexsort((h2, h1, code))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        heads = order[new]
        self.w_code, self.w1, self.w2 = code[heads] << U(32), h1[heads], h2[heads]
        self.w_many = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        self.window_of = np.empty(len(order), np.int64)
        self.window_of[order] = np.cumsum(new) - 1

    def removed(self, repeats: np.ndarray) -> np.ndarray:
        """Mask of the words to remove."""
        starts = np.concatenate([self.sure, self.check[repeats[self.window_of] > 0]])
        depth = np.zeros(self.n + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + self.window, -1)
        return np.cumsum(depth[:-1]) > 0


def answer_nodes(bucket: pa.Table) -> pa.Table:
    """Does a node repeat, and do all its occurrences have the same edge to the right, to the left?"""
    codes, sizes = joined(bucket.column("part"), np.uint32)
    many, _ = joined(bucket.column("ids"), np.uint8)
    edges, _ = joined(bucket.column("extra"), U)
    at = np.repeat(np.cumsum(2 * sizes) - 2 * sizes, sizes) + np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(codes, kind="stable")
    c = codes[order]
    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(c))))
    way = ((np.diff(np.append(head, len(c))) > 1) | (np.maximum.reduceat(many[order], head) > 0)) * np.uint8(REPEATED)
    for side, bit in ((at, RIGHT), (at + np.repeat(sizes, sizes), LEFT)):
        e = edges[side][order]
        low, high = np.minimum.reduceat(e, head), np.maximum.reduceat(e, head)
        way = way | ((low == high) & (low > 0)) * np.uint8(bit)
    out = np.empty(len(c), np.uint8)
    out[order] = way[group]
    return answered(bucket, sizes, out, 1)


def answer_windows(bucket: pa.Table) -> pa.Table:
    """Which windows occur twice?"""
    h1, sizes = joined(bucket.column("part"), U)
    h2, _ = joined(bucket.column("extra"), U)
    many, _ = joined(bucket.column("ids"), np.uint8)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    size = np.diff(np.append(head, len(order)))
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat((size > 1) | (np.maximum.reduceat(many[order], head) > 0), size)
    return answered(bucket, sizes, out, 2)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``spans`` of removed words and the ``kept`` text."""
    text, size = F.col(text_col), docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks, buckets = size // CHUNK_BYTES + 1, size // BUCKET_BYTES + 1
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("id"), text.alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def opened(chunk: pa.Table) -> Graph:
        return Graph(chunk.column("text"), window, node, buckets)

    def send_nodes(chunk: pa.Table) -> pa.Table:
        graph, name = opened(chunk), chunk.column("chunk")[0].as_py()
        (many, right, left), low = graph.nodes(), (graph.codes & LOW).astype(np.uint32)
        return table([{"bucket": b, "chunk": name, "part": low[a:e].tobytes(), "extra": right[a:e].tobytes() + left[a:e].tobytes(),
                       "ids": many[a:e].astype(np.uint8).tobytes()} for b, a, e in slices(graph.codes)], SENT_TYPE)

    def send_windows(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return table([], SENT_TYPE)
        graph, name = opened(chunk), chunk.column("chunk")[0].as_py()
        graph.pieces(answers_for(answers, 1, graph.codes, np.uint8))
        return table([{"bucket": b, "chunk": name, "part": graph.w1[a:e].tobytes(), "extra": graph.w2[a:e].tobytes(),
                       "ids": graph.w_many[a:e].astype(np.uint8).tobytes()} for b, a, e in slices(graph.w_code)], SENT_TYPE)

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return out_type.empty_table()
        graph = opened(chunk)
        graph.pieces(answers_for(answers, 1, graph.codes, np.uint8))
        gone = graph.removed(answers_for(answers, 2, graph.w_code, np.uint8))
        spans, kept = [], []
        for a, e, x, y in zip(*(v.tolist() for v in (graph.starts, graph.ends, graph.from_byte, graph.to_byte))):
            words = graph.data[x:y].tobytes().split()  # of bytes: ASCII white space only
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:e], [False])).astype(np.int8))).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            inside = [0, *edge, e - a]
            kept.append(b" ".join([w for x, y in zip(inside[::2], inside[1::2]) for w in words[x:y]]).decode("utf-8"))
        return pa.Table.from_arrays([chunk.column("id"), pa.array(graph.ends - graph.starts, pa.int64()), pa.array(spans, pa.list_(span)),
                                     pa.array(kept, pa.string())], ["id", "n_words", "spans", "kept"])

    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                        T.StructField("kept", T.StringType())])
    out_type = pa.schema([("id", pa.string() if isinstance(id_type, T.StringType) else pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.string())])
    by_chunk = rows.groupBy("chunk")
    known = by_chunk.applyInArrow(send_nodes, SENT).groupBy("bucket").applyInArrow(answer_nodes, ANSWER)
    opened_windows = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send_windows, SENT)
    verified = opened_windows.groupBy("bucket").applyInArrow(answer_windows, ANSWER)
    found = by_chunk.cogroup(known.unionByName(verified).groupBy("chunk")).applyInArrow(cut, out)
    return found.withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

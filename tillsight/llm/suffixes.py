"""Removal of repeated byte strings: longest previous factors in suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document
of a smaller id.  In suffix order equal strings are neighbours; with ties ordered by
document, the previous smaller position of a suffix tells whether a smaller document
shares ``LENGTH`` bytes with it, that is whether its longest previous factor is that
long.  (The next smaller position can't: a tie after it has no smaller document.)

A suffix array of everything would need every position in one order.  Here
positions are dealt out first, so that equal strings meet in one bucket:

1. Documents are dealt into chunks of some MB.  Each string of ``LENGTH`` bytes picks an
   anchor, its least k-gram (``windows.anchors``); neighbouring strings mostly share one.
2. Each chunk sends its distinct anchor codes to buckets, and each bucket answers with
   one bit for each: does another document have it?  Four fifths of a text end here.
3. For the anchors left, a chunk sends each distinct stretch of text whose strings share
   the anchor, with its smallest document.  In the bucket, stretches that equal one of a
   smaller document are earlier copies as a whole; where an anchor has several different
   stretches, the suffixes in them are put in order and their longest previous
   factors decide string by string.  The answer is a bit for each string.
4. A hot anchor, of which the chunks hold more than ``HOT`` stretches in all (a phrase with other
   neighbours in each document), is not sent as stretches.  Its distinct strings go out by the hash
   of the whole string instead, each with its smallest document; the bucket answers whether
   another chunk has a smaller one.
5. Chunks turn the bits into spans and cut them out.

Chunks and buckets have a fixed mean size, their number grows with the data.  A passage
that a third of all documents repeat is sent once by each chunk, not once by each document.
Text is shuffled once: the chunks are read three times from the same shuffle.

Codes are 32 bits within a bucket and only filter; stretches and strings of hot anchors are
compared by 128 bits, suffixes by their bytes.

Defined cases: null text has no bytes.  Rows without an id keep all their bytes and are nobody's
earlier copy.  Rows that repeat an id are one document's: they never remove each other's
bytes.  Shorter texts than ``LENGTH`` keep all.  Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.buckets import ANSWER, LOW, SENT, SENT_TYPE, answered, answers_for, bucketed, joined, slices, table
from tillsight.llm.windows import PLACE, mixed

LENGTH = 50
GRAM = 20
#: Strings looked at in one go.
BLOCK = 1 << 15
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Stretches under one code that a bucket takes; 31 strings of 7 keys each make some 100 MB of these.
HOT = 1 << 16
#: Up to so many stretches under one code, a chunk doesn't look which are equal to count them.
FEW = 8
#: The answers to codes.
ALONE, SHARED, DEALT = range(3)
OUT = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
U = np.uint64
PAIR = np.dtype([("h1", U), ("h2", U)])


FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def anchor_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of ``length`` bytes with the same anchor: their starts, and
    the anchors' hashes.  A block at a time, so that the work stays in the cache."""
    n, span, words = len(data) - length + 1, length - gram + 1, words_of(data)
    at_byte = [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]
    starts, places, hashes = [], [], []
    for at in range(0, max(n, 0), BLOCK):
        m = min(BLOCK, n - at) + span - 1
        h = words[at : at + m] * FACTORS[0]
        for j, step in enumerate(at_byte[1:], 1):
            h += words[at + step : at + step + m] * FACTORS[j % len(FACTORS)]
        h ^= h >> U(32)
        h *= FACTORS[-1]
        low = (h & ~PLACE) | np.arange(m, dtype=U)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: step - span], low[span - step :])
        new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        place = (low[new] & PLACE).astype(np.int64)
        starts.append(new + at)
        places.append(place + at)
        hashes.append(h[place])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    start, place, h = np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate(([True], place[1:] != place[:-1]))  # a block may go on with the last one's run
    return start[new], h[new]


def short_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each range of at most some dozen bytes."""
    h1, h2 = lengths.astype(U) * FACTORS[0], lengths.astype(U) * FACTORS[1]
    for step in range(0, int(lengths.max(initial=0)), 8):
        left = lengths - step
        w = words[np.minimum(starts + step, len(words) - 1)]
        w = np.where(left >= 8, w, w & ((U(1) << (U(8) * np.clip(left, 0, 7).astype(U))) - U(1)))
        on = left > 0
        h1 = np.where(on, mixed(h1 ^ w), h1)
        h2 = np.where(on, mixed(h2 + w * FACTORS[2]), h2)
    return h1, h2


class Chunk:
    """The rows of a chunk as one byte array, and the stretches of strings that share an anchor.

    Nothing that is sent or answered depends on the order of the rows."""

    def __init__(self, rows: pa.Table, length: int, gram: int, buckets: int):
        texts = rows.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        self.starts, self.ends = edges[:-1] - edges[0], edges[1:] - edges[0]
        self.ids = rows.column("id").combine_chunks()
        self.length, self.buckets = length, buckets
        self.find(gram)

    def find(self, gram: int) -> None:
        run, h = anchor_runs(self.data, self.length, gram)
        known = np.asarray(self.ids.is_valid()) & (self.ends - self.starts >= self.length)
        first, last = self.starts[known], self.ends[known] - self.length  # strings of the documents
        # runs don't stop at documents: cut them to each one's strings
        a, b = np.searchsorted(run, first, side="right") - 1, np.searchsorted(run, last, side="right") - 1
        count = b - a + 1
        doc = np.repeat(np.arange(len(first)), count)
        which = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        stop = np.append(run[1:], len(self.data))[which] - 1 if len(run) else which
        self.s0 = np.maximum(run[which], first[doc])  # first and last string of each stretch
        self.s1 = np.minimum(stop, last[doc])
        self.row = np.flatnonzero(known)[doc]
        self.doc = np.asarray(self.ids.fill_null(0)).astype(np.int64)[self.row]
        self.code = bucketed(mixed(h[which] ^ U(0xA24BAED4963EE407)), self.buckets)
        self.codes, self.code_of = np.unique(self.code, return_inverse=True)

    def shared_here(self) -> np.ndarray:
        """Of each code: whether two documents of this chunk have it."""
        low, high = np.full(len(self.codes), np.iinfo(np.int64).max), np.full(len(self.codes), np.iinfo(np.int64).min)
        np.minimum.at(low, self.code_of, self.doc)
        np.maximum.at(high, self.code_of, self.doc)
        return low < high

    def counts(self) -> np.ndarray:
        """Of each code: the distinct stretches here, in quarters of a power of two, rounded up."""
        count = np.bincount(self.code_of, minlength=len(self.codes))
        many = np.flatnonzero(count[self.code_of] > FEW)
        if len(many):
            a, b = self.s0[many], self.s1[many] + self.length
            h1, h2 = short_hashes(words_of(self.data), a, b - a)
            of = self.code_of[many]
            order = np.lexsort((h2, h1, of))
            c, x, y = of[order], h1[order], h2[order]
            new = np.concatenate(([True], (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            count = np.where(count > FEW, np.bincount(c[new], minlength=len(count)), count)
        return np.ceil(4 * np.log2(np.maximum(count, 1))).astype(np.uint8)

    def strings(self, dealt: np.ndarray) -> None:
        """Distinct strings under dealt codes, by their own code; their smallest document, and whose they are."""
        of = np.flatnonzero(dealt[self.code_of])
        count = (self.s1 - self.s0)[of] + 1
        self.t_of = np.repeat(of, count)
        self.t_at = self.s0[self.t_of] + np.arange(len(self.t_of)) - np.repeat(np.cumsum(count) - count, count)
        doc = self.doc[self.t_of]
        h1, h2 = short_hashes(words_of(self.data), self.t_at, np.full(len(self.t_at), self.length))
        code = bucketed(mixed(h1 ^ U(0x8EBC6AF09C88C6E3)), self.buckets) + (U(self.buckets) << U(32))  # after the stretches' buckets
        order = np.lexsort((doc, h2, h1, code))
        c, x, y = code[order], h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        heads = order[new]
        self.string_of = np.empty(len(order), np.int64)
        self.string_of[order] = np.cumsum(new) - 1
        self.t_code, self.t_doc, self.t_pair = code[heads], doc[heads], np.empty(len(heads), PAIR)
        self.t_pair["h1"], self.t_pair["h2"] = h1[heads], h2[heads]

    def stretches(self, shared: np.ndarray) -> None:
        """Distinct stretches under shared codes, by code; their smallest document, and whose they are."""
        self.of = np.flatnonzero(shared[self.code_of])
        a, b = self.s0[self.of], self.s1[self.of] + self.length
        h1, h2 = short_hashes(words_of(self.data), a, b - a)
        code = self.code[self.of]
        order = np.lexsort((a, self.doc[self.of], h2, h1, code))
        new = np.ones(len(order), bool)
        c, x, y = code[order], h1[order], h2[order]
        new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        heads = order[new]
        self.stretch_of = np.empty(len(order), np.int64)
        self.stretch_of[order] = np.cumsum(new) - 1
        self.s_code, self.s_from, self.s_len, self.s_doc = code[heads], a[heads], b[heads] - a[heads], self.doc[self.of][heads]


OUT_TYPE = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def answer_codes(bucket: pa.Table, hot: int) -> pa.Table:
    """Which codes does more than one chunk, or more than one document of a chunk, have?  And which have
    more than ``hot`` stretches?"""
    codes, sizes = joined(bucket.column("part"), np.uint32)
    here, _ = joined(bucket.column("extra"), np.uint8)
    order = np.argsort(codes, kind="stable")
    c = codes[order]
    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    count = np.diff(np.append(head, len(c)))
    many = np.add.reduceat(np.exp2((here[order] >> 1) / 4), head) > hot
    shared = (count > 1) | (np.maximum.reduceat(here[order] & 1, head) > 0)
    out = np.empty(len(c), np.uint8)
    out[order] = np.repeat(np.where(shared, np.where(many, DEALT, SHARED), ALONE), count)
    return answered(bucket, sizes, out, 1)


def previous_factors(data: np.ndarray, suffixes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix: does its longest previous factor, the longest match with a suffix of a
    smaller document, reach ``length``?"""
    if not len(suffixes):
        return np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    keys = [words[suffixes + at].astype(U) for at in range(0, length - 7, 8)]
    if length % 8:
        keys.append(words[suffixes + length - 8].astype(U))
    order = np.lexsort((docs, *reversed(keys)))  # suffix order, ties by document
    same = np.ones(len(order) - 1, bool)  # with the one before: at least ``length`` bytes in common
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    run = np.cumsum(np.concatenate(([True], ~same))) - 1
    least = docs[order][np.flatnonzero(np.concatenate(([True], ~same)))]  # the run's first is its smallest
    out = np.empty(len(order), bool)
    out[order] = least[run] < docs[order]
    return out


def answer_stretches(bucket: pa.Table, length: int) -> pa.Table:
    """A bit for each string of each stretch: is it in a smaller document?"""
    codes, sizes = joined(bucket.column("part"), np.uint32)
    docs, _ = joined(bucket.column("ids"), np.int64)
    blobs = bucket.column("extra").to_pylist()  # lengths, one byte each, then the text
    lens = np.concatenate([np.frombuffer(b, np.uint8, n) for b, n in zip(blobs, sizes.tolist())]).astype(np.int64)
    data = np.concatenate([np.frombuffer(b, np.uint8, offset=n) for b, n in zip(blobs, sizes.tolist())])
    ends = np.cumsum(lens)
    starts = ends - lens
    h1, h2 = short_hashes(words_of(data), starts, lens)
    order = np.lexsort((docs, h2, h1, codes))
    c, x, y = codes[order], h1[order], h2[order]
    new_code = np.concatenate(([True], c[1:] != c[:-1]))
    new = new_code.copy()
    new[1:] |= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.cumsum(new) - 1
    heads = order[new]  # of each distinct stretch, the one of the smallest document
    variants = np.bincount(np.cumsum(new_code)[new] - 1)
    several = variants[np.cumsum(new_code)[new] - 1] > 1
    strings = lens[heads] - length + 1
    mask = np.zeros(len(heads), np.uint32)
    if several.any():
        some = np.flatnonzero(several)
        owner = np.repeat(some, strings[some])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(strings[some]) - strings[some], strings[some])
        earlier = previous_factors(data, starts[heads][owner] + place, docs[heads][owner], length)
        np.bitwise_or.at(mask, owner[earlier], (np.uint32(1) << place[earlier].astype(np.uint32)))
    out = np.empty(len(order), np.uint32)
    whole = docs[order] > docs[heads][group]
    out[order] = np.where(whole, np.uint32(0xFFFFFFFF), mask[group])
    return answered(bucket, sizes, out, 2)


def answer_strings(bucket: pa.Table) -> pa.Table:
    """For each string: does another chunk have it in a smaller document?"""
    docs, _ = joined(bucket.column("ids"), np.int64)
    hashes, sizes = joined(bucket.column("extra"), PAIR)
    h1, h2 = hashes["h1"], hashes["h2"]
    order = np.lexsort((docs, h2, h1))
    x, y = h1[order], h2[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    out = np.empty(len(order), np.uint8)
    out[order] = docs[order][new][np.cumsum(new) - 1] < docs[order]
    return answered(bucket, sizes, out, 3)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` of removed bytes, ``kept`` (binary)."""
    if not 8 <= gram <= length <= gram + 31:
        raise ValueError("8 <= gram <= length <= gram + 31: a stretch has at most 32 strings")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks, buckets, hot = size // CHUNK_BYTES + 1, size // BUCKET_BYTES + 1, HOT
    text = F.col(text_col)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("long").alias("id"), text.alias("text"))

    def opened(part: pa.Table) -> Chunk:
        return Chunk(part, length, gram, buckets)

    def send_codes(part: pa.Table) -> pa.Table:
        chunk, name = opened(part), part.column("chunk")[0].as_py()
        here, low = chunk.shared_here().astype(np.uint8) | chunk.counts() << 1, (chunk.codes & LOW).astype(np.uint32)
        return table([{"bucket": b, "chunk": name, "part": low[a:e].tobytes(), "extra": here[a:e].tobytes(), "ids": b""}
                      for b, a, e in slices(chunk.codes)], SENT_TYPE)

    def code_answers(bucket: pa.Table) -> pa.Table:
        return answer_codes(bucket, hot)

    def send_stretches(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return table([], SENT_TYPE)
        chunk, name = opened(part), part.column("chunk")[0].as_py()
        known = answers_for(answers, 1, chunk.codes, np.uint8)
        chunk.stretches(known == SHARED)
        low, lens, data = (chunk.s_code & LOW).astype(np.uint32), chunk.s_len.astype(np.uint8), chunk.data
        sent = [{"bucket": b, "chunk": name, "part": low[a:e].tobytes(), "ids": chunk.s_doc[a:e].tobytes(),
                 "extra": lens[a:e].tobytes() + b"".join(data[f : f + n].tobytes() for f, n in zip(chunk.s_from[a:e].tolist(), chunk.s_len[a:e].tolist()))}
                for b, a, e in slices(chunk.s_code)]
        if (known == DEALT).any():
            chunk.strings(known == DEALT)
            sent += [{"bucket": b, "chunk": name, "part": b"", "ids": chunk.t_doc[a:e].tobytes(), "extra": chunk.t_pair[a:e].tobytes()}
                     for b, a, e in slices(chunk.t_code)]
        return table(sent, SENT_TYPE)

    def cut(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return table([], OUT_TYPE)
        chunk = opened(part)
        known = answers_for(answers, 1, chunk.codes, np.uint8)
        chunk.stretches(known == SHARED)
        mask = answers_for(answers, 2, chunk.s_code, np.uint32)[chunk.stretch_of]
        mask = np.where(chunk.doc[chunk.of] > chunk.s_doc[chunk.stretch_of], np.uint32(0xFFFFFFFF), mask)
        hit = np.flatnonzero(mask)
        first, strings = chunk.s0[chunk.of][hit], (chunk.s1 - chunk.s0)[chunk.of][hit] + 1
        at, row = np.repeat(first, strings), np.repeat(chunk.row[chunk.of][hit], strings)
        place = np.arange(len(at)) - np.repeat(np.cumsum(strings) - strings, strings)
        gone = np.repeat(mask[hit], strings) >> place.astype(np.uint32) & np.uint32(1) > 0
        found, row = (at + place)[gone], row[gone]  # strings to remove, in order
        if (known == DEALT).any():
            chunk.strings(known == DEALT)
            earlier = answers_for(answers, 3, chunk.t_code, np.uint8)[chunk.string_of] > 0
            earlier |= chunk.doc[chunk.t_of] > chunk.t_doc[chunk.string_of]
            found, row = np.append(found, chunk.t_at[earlier]), np.append(row, chunk.row[chunk.t_of[earlier]])
            order = np.argsort(found, kind="stable")
            found, row = found[order], row[order]
        new = np.concatenate(([True], (np.diff(found) > length) | (row[1:] != row[:-1]))) if len(found) else np.zeros(0, bool)
        span_row, span_from = row[new], found[new]
        span_to = found[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)] + length if len(found) else found
        begin, end = np.searchsorted(span_row, np.arange(len(chunk.starts))), np.searchsorted(span_row, np.arange(len(chunk.starts)), side="right")
        out, whole = [], chunk.data
        for i, x, y, a, e in zip(chunk.ids.to_pylist(), begin.tolist(), end.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
            spans = list(zip(span_from[x:y].tolist(), span_to[x:y].tolist()))
            kept, done = [], a
            for f, t in spans:
                kept.append(whole[done:f].tobytes())
                done = t
            kept.append(whole[done:e].tobytes())
            out.append({"id": i, "n_bytes": e - a, "spans": [{"start": f - a, "end": t - a} for f, t in spans], "kept": b"".join(kept)})
        return table(out, OUT_TYPE)

    def stretch_answers(bucket: pa.Table) -> pa.Table:
        return answer_strings(bucket) if bucket.column("bucket")[0].as_py() >= buckets else answer_stretches(bucket, length)

    by_chunk = rows.groupBy("chunk")
    known = by_chunk.applyInArrow(send_codes, SENT).groupBy("bucket").applyInArrow(code_answers, ANSWER)
    stretches = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send_stretches, SENT)
    answers = stretches.groupBy("bucket").applyInArrow(stretch_answers, ANSWER)
    out = by_chunk.cogroup(known.unionByName(answers).groupBy("chunk")).applyInArrow(cut, OUT)
    return out.withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

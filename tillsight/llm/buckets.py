"""Questions from chunks to buckets and back.

A chunk is a group of documents of some MB, a bucket a range of hashes.  A chunk sends each
bucket its distinct codes there, ascending, with what belongs to them; the bucket answers with as many
values for each chunk.  A chunk that is read again makes the same codes, so answers need
no keys.  A code that a third of all documents have is sent once by each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
LOW = U(0xFFFFFFFF)
SENT = "bucket long, chunk long, part binary, extra binary, ids binary"
ANSWER = "chunk long, kind int, bucket long, bits binary"
SENT_TYPE = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("part", pa.binary()), ("extra", pa.binary()), ("ids", pa.binary())])
ANSWER_TYPE = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])


def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Codes: the bucket in the upper half, 32 bits of the hash in the lower."""
    return (((hashes >> U(32)) * U(buckets)) >> U(32) << U(32)) | (hashes & LOW)


def slices(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of ascending codes."""
    which = (codes >> U(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(codes)]
    return [(int(which[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array, and the count of each."""
    parts = [np.frombuffer(b, dtype) for b in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def answered(bucket: pa.Table, sizes: np.ndarray, values: np.ndarray, kind: int) -> pa.Table:
    """``values``, one for each code sent, back to the chunks."""
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    name, raw = bucket.column("bucket")[0].as_py(), values.dtype.itemsize
    data = values.tobytes()
    return table([{"chunk": c, "kind": kind, "bucket": name, "bits": data[a * raw : b * raw]}
                  for c, a, b in zip(bucket.column("chunk").to_pylist(), edges, edges[1:])], ANSWER_TYPE)


def answers_for(answers: pa.Table, kind: int, codes: np.ndarray, dtype) -> np.ndarray:
    """The buckets' answers of a kind, in the order of ``codes``."""
    got = {b: p for k, b, p in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}
    out = np.zeros(len(codes), dtype)
    for bucket, a, b in slices(codes):
        out[a:b] = np.frombuffer(got[bucket], dtype)
    return out

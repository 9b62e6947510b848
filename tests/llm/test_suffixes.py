import hashlib
import random

import numpy as np
import pytest

from tillsight.llm import suffixes


def brute(rows, length=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(suffixes.remove_repeats(docs)).collect())


def spliced(seed):
    """Documents made of shared and own passages, with runs of one letter and of two."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 160))) for _ in range(12)] + ["z" * 120, "yx" * 70, "é" * 40]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(shared)
            parts.append(rng.choice([s, s[rng.randint(0, 20) :], s[: rng.randint(20, 120)], "".join(rng.choice("efgh ") for _ in range(rng.randint(1, 60)))]))
        rows.append((rng.randint(0, 60), "".join(parts)))
    return rows


@pytest.mark.parametrize("chunk", [1 << 10, 4 << 20])
def test_against_brute_force(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk * 20)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", chunk * 30)
    rows = list(texts)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_spliced_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    rows = spliced(7)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows)
    assert found(empty) == []


def test_previous_factors():
    data = np.frombuffer(b"abcdefghijabcdefghijXabcdefghij", np.uint8)
    at = np.arange(0, 22)
    docs = np.array([1] * 10 + [2] * 10 + [3] * 2)
    got = suffixes.previous_factors(data, at, docs, 10)
    want = [any(docs[j] < docs[i] and data[j : j + 10].tobytes() == data[i : i + 10].tobytes() for j in at) for i in at]
    assert got.tolist() == want


def test_hot_anchor_is_dealt_by_string(spark, monkeypatch):
    """A phrase that most documents hold, with other neighbours in each, doesn't meet in one bucket."""
    rng, phrase = random.Random(3), "all rights reserved by the owner of it"
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, own(60) + phrase + own(60)) for i in range(300)]
    rows += [(rng.randint(0, 400), t[rng.randint(0, 60) :]) for _, t in rng.sample(rows, 60)] + spliced(11) + [(None, rows[3][1])]
    whole, limit = suffixes.answer_stretches, 64

    def checked(bucket, length):
        codes, _ = suffixes.joined(bucket.column("part"), np.uint32)
        assert not len(codes) or np.unique(codes, return_counts=True)[1].max() <= limit
        return whole(bucket, length)

    monkeypatch.setattr(suffixes, "answer_stretches", checked)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 12000)
    monkeypatch.setattr(suffixes, "HOT", limit, raising=False)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_all_codes_dealt(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixes, "HOT", 0)
    rows = spliced(7)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rows_that_repeat_are_dealt_out(spark, monkeypatch):
    """Rows alike in id and text fill no single chunk: each input partition's go to one of their own."""
    text = "the same long text again and again, with a passage of more than fifty bytes in it. " * 3
    rows = [(7, text)] * 400 + [(None, text)] * 40 + [(1, "something else before " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 4_000)
    got = suffixes.digests(suffixes.remove_repeats(docs)).collect()
    assert len(got) == len(rows) and {r.n_removed for r in got if r.doc_id == 7} == {len(text)}
    assert [(r.n_bytes, r.n_removed) for r in got if r.doc_id == 1] == [(len(rows[-1][1]), 0)]

import hashlib

import pytest

from tillsight.llm import radix


def brute(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i is not None, i, at))
    out = []
    for t, members in groups.items():
        keep = max(members, key=lambda m: (m[0], m[1] or 0))[1]
        left = 1
        for _, i, _ in members:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(members), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(params=[(256, 32), (1, 2), (3, 4)])
def widths(request, monkeypatch):
    first, growth = request.param
    monkeypatch.setattr(radix, "FIRST", first)
    monkeypatch.setattr(radix, "GROWTH", growth)


def test_against_brute_force(spark, texts, odd_rows, widths):
    rows = [(i, t and t[:2500]) for i, t in texts[:60]] + [(None if i is None else i + 5000, t and t[:3000]) for i, t in odd_rows]
    got = radix.copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(got.collect()) == order(brute(rows))


def test_whole_texts(spark, texts, odd_rows):
    rows = list(texts) + [(None if i is None else i + 5000, t) for i, t in odd_rows]
    assert order(radix.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == order(brute(rows))


def test_ends_of_digits(spark, monkeypatch):
    monkeypatch.setattr(radix, "FIRST", 4)
    monkeypatch.setattr(radix, "GROWTH", 2)
    words = ["", "a", "abcd", "abcde", "abcdefghijkl", "abcdefghijklm", "abcdefghijkx", "abcé", "abcé", "abcé", "abcd\x00", "ABCD"]
    rows = [(i, w) for i, w in enumerate(words * 3)] + [(99, "abcdefghijkl")]
    assert order(radix.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == order(brute(rows))


def test_hot_group_and_ties(spark):
    rows = [(i % 500, "the same text " * 300) for i in range(1500)] + [(i, f"text {i} " * 50) for i in range(500, 900)] + [(None, None)] * 5
    got = radix.copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert order(got) == order(brute(rows))
    assert sum(r.kept for r in got) == 402


def test_survivors_keep_all_columns(spark, odd, odd_rows, empty):
    kept = radix.survivors(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    want = [(i, t) for (i, t), b in zip(odd_rows, [None] * len(odd_rows))]
    assert order((r.doc_id, r.text or "") for r in got) == order((b[0], t) for b, t in _winners(want))
    assert all(r[c] == "clash" for r in got for c in odd.columns[2:])
    assert radix.survivors(empty).count() == 0 and radix.copies(empty).count() == 0


def _winners(rows):
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    return [(b, sha[b[4]]) for b in brute(rows) if b[3]]


def test_string_ids(spark):
    rows = [("a", "x"), ("b", "x"), (None, "x"), ("c", "y")]
    got = radix.copies(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert order(got) == order([("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False), ("c", "c", 1, True)])

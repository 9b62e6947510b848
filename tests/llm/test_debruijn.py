import hashlib
import random
import re
from collections import Counter

import pytest

from tillsight.llm import debruijn


def brute(rows, window=35):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.digests(debruijn.repeated_spans(docs)).collect())


def test_small_table(spark, texts):
    assert found(spark.createDataFrame(texts, "doc_id long, text string")) == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_branching_paths(spark, seed):
    """Passages shared in different lengths, one after the other in many orders, and periodic text."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}"
    shared = [[word() for _ in range(rng.randint(20, 120))] for _ in range(8)] + [["la"] * 80, ["ho", "hum"] * 40]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(shared)
            a = rng.randint(0, 10)
            w += rng.choice([s, s[a:], s[: len(s) - a], [word() for _ in range(rng.randint(1, 40))]])
        rows.append((i, " ".join(w)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows)
    assert found(empty) == []

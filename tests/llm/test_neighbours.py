import numpy as np
import pytest

from tillsight.llm import neighbours


def brute(rows, k=20):
    ok = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = []
    for q in ids[ids % 20 == 0]:
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += ok[q][d] * x[:, d]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(int(q), r, int(ids[j]), float(s[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(c) for c in centres[i % 12] + rng.normal(size=16)]) for i in range(3000)]
    hot = rows[7][1]
    return [(i, hot if i % 3 == 0 else v) for i, v in rows]  # a third of all rows repeat one vector


def test_all_parts_are_exact(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbours.nearest(df, probes=10**6).collect())) == brute(vectors)


def test_recall(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_A_SQUARE", 20)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 50)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert neighbours.recall(df) >= 0.9


def test_parts_are_balanced(vectors):
    x = np.array([v for i, v in vectors if i % 3])
    sizes = np.bincount(neighbours.balanced_parts(x, 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 8


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(45)]
    rows += [(100, None), (120, [0.0] * 16), (140, [float("nan")] + [1.0] * 15), (160, [float("inf")] + [1.0] * 15), (180, [None] + [1.0] * 15),
             (200, [1.0, 2.0]), (220, []), (None, rows[3][1])]
    schema = "vec_id long, embedding array<double>, id string, v string, score string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = sorted(map(tuple, neighbours.nearest(df).collect()))
    assert got == brute(rows) and {q for q, *_ in got} == {0, 20, 40}
    again = df.unionByName(df.where("vec_id in (3, 20)"))  # repeated rows are one candidate
    assert sorted(map(tuple, neighbours.nearest(again).collect())) == got
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r["rank"]) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]

import math
from fractions import Fraction

import numpy as np
import pytest

from tillsight.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=4):
    """Each kept row's id and vector of whole numbers; the fit list's n, sums, eigenvalues and eigenvectors."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(((sum(len(x) == d for _, x in ok), d) for d in {len(x) for _, x in ok}))[1]
    ok = [(i, x) for i, x in ok if len(x) == dims]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return ok, n, sums, values[::-1], vectors[:, ::-1]


def check(got, rows, k=4):
    ok, n, sums, values, vectors = brute(rows)
    k = min(k, len(sums))
    mean = np.array([s / n for s in sums])
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1)) and len(got) == k * len(ok)
    for c in by:
        mine = sorted(((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in by[c]), key=lambda r: (r[0], r[1], abs(r[2])))
        want = sorted(((i if i is not None else -1, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                        float((np.array(x) - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1]))) for i, x in ok), key=lambda r: (r[0], r[1], abs(r[2])))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert {r.n for r in by[c]} == {n} and abs(by[c][0].explained / (values[c - 1] / values.sum()) - 1) < 1e-9
        assert len({r.identity_error for r in by[c]}) == 1 and by[c][0].identity_error < 1e-10


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)) * np.linspace(2, 0.3, 12) / 4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # a third of all rows repeat one vector


def test_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(7)
    check(whitening.whitened(df).collect(), vectors)


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whitened(df).collect(), [(r.vec_id, list(r.embedding)) for r in df.collect()])


def test_odd_rows(spark, vectors):
    rows = vectors[:60] + [(100, None), (101, []), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, [None] + [1.0] * 11), (105, [1.0, 2.0]),
                           (None, vectors[1][1]), (3, vectors[3][1]), (106, [-0.0] * 12), (107, [-1e-9] * 12)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA + ", x string, id string, whitened string")
    got = whitening.whitened(df).collect()
    check(got, rows)
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id between 100 and 104")).count() == 0


def test_nothing_varies(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], SCHEMA)
    got = whitening.whitened(same).collect()
    assert len(got) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], SCHEMA)
    got = whitening.whitened(line).collect()
    assert {r.whitened is None for r in got if r.component == 1} == {False} and {r.whitened for r in got if r.component == 2} == {None}


def test_values_beyond_a_long(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], SCHEMA)).collect()
    assert len(got) == 6 and {r.deviation for r in got} == {None} or all(r.deviation is None or r.deviation >= 0 for r in got)
    big = np.array([[2**40, -(2**40)], [3, 2**41]])
    assert whitening.deviations(big, 5, [7, 9]) == [None if (e := sum((5 * int(c) - s) ** 2 for c, s in zip(x, (7, 9)))) >= 1 << 63 else e for x in big]
    small = np.array([[2**28, -(2**28)], [3, 2**29]])
    assert whitening.deviations(small, 5, [7, -9]) == [sum((5 * int(c) - s) ** 2 for c, s in zip(x, (7, -9))) for x in small]


@pytest.mark.parametrize("values", [
    np.linspace(1, 60, 60), np.concatenate([np.ones(20) * 5, np.linspace(1, 4, 40)]), 3 + 1e-9 * np.arange(60),
    np.concatenate([[1e6], 3 + 1e-8 * np.arange(59)]), np.r_[10 + 1e-5 * np.arange(4), np.linspace(0, 1, 56)], np.zeros(60), np.r_[np.zeros(57), 1, 1, 2]])
def test_eigen_of_clustered_values(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    a = (q * values) @ q.T
    got, x = whitening.eigen((a + a.T) / 2)
    size = max(1e-300, np.abs(values).max())
    assert np.abs(got - np.sort(values)[::-1]).max() <= 1e-13 * size
    assert np.abs(x.T @ x - np.eye(60)).max() < 1e-12
    assert np.abs(a @ x - x * got).max() <= 1e-12 * size

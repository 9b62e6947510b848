"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors chosen by a hash of the id) the driver builds the
neighbour graph, cuts it into parts of equal size with few edges between them (spectral
bisection, then swaps), and trains a small classifier, softmax over the components,
to tell from a vector in which parts its neighbours lie.  The whole table is indexed:
every vector goes to its most probable part.  A query is sent to its most
probable parts and compared exactly with all vectors there.

How many parts are probed follows from recall measured on sample vectors that the
classifier was not trained on: the fewest that reach ``TARGET``; vectors without
structure need most of the parts, and all of them is exact search.  ``recall`` measures
it on the whole table.

A part is dealt out in blocks of rows and blocks of queries, from counts per part, so a
vector that a third of all rows repeat fills many blocks and not one task.  Each pair of
blocks keeps its best ``k`` for each query; their union is ranked at last.

Scores are sums of products in double precision, component by component in order, so equal vectors
have equal scores; ties go to the smaller id.

Defined cases: null ids, null vectors, empty and zero vectors, vectors with a null or
non-finite component, and vectors of another length than the most frequent one take no
part.  Rows that repeat an id are one candidate, with its highest score, and never a
neighbour of their own id.  Fewer than ``k`` candidates give them all, an empty table
gives an empty result.  Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SAMPLE = 8_192
HELD_OUT = 512
NEIGHBOURS = 10
TARGET = 0.96
#: The number of parts grows with the square root of the rows: (parts * parts) * this <= rows.
ROWS_A_SQUARE = 100
MOST_PARTS = 256
#: Rows and queries compared in one task at a time.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8_192
K = 20


@dataclass
class Router:
    """Softmax weights (components + 1, parts) and the number of parts to probe."""

    weights: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges to the ``k`` vectors of largest inner product."""
    k = min(k, len(x) - 1)
    ends = []
    for i in range(0, len(x), 256):  # a few MB at a time on the driver
        s = x[i : i + 256] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        ends.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.repeat(np.arange(len(x)), k), np.concatenate(ends).ravel()


def bisected(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` with few edges of (u, v) between them."""
    local = np.full(total, -1)
    local[nodes] = np.arange(len(nodes))
    inside = (local[u] >= 0) & (local[v] >= 0)
    a, b, n = local[u[inside]], local[v[inside]], len(nodes)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.sqrt(np.bincount(a, minlength=n) + 1.0)
    first = degree / np.linalg.norm(degree)
    x = np.cos(np.arange(n) * 2.399963)  # a fixed start
    for _ in range(60):
        x = x - first * (first @ x)
        x = (x + np.bincount(a, weights=x[b] / degree[b], minlength=n) / degree) / 2
        x /= np.linalg.norm(x) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(x / degree, kind="stable")[n // 2 :]] = True
    for _ in range(20):  # swap the nodes that gain most, as many from either side
        across = np.bincount(a, weights=(side[a] != side[b]) * 2.0 - 1.0, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-across[left], kind="stable")], right[np.argsort(-across[right], kind="stable")]
        m = min(len(left), len(right))
        gain = int(np.count_nonzero(across[left[:m]] + across[right[:m]] > 2.0)) // 4
        if not gain:
            break
        side[left[:gain]], side[right[:gain]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(x: np.ndarray, parts: int) -> np.ndarray:
    u, v = neighbour_graph(x, NEIGHBOURS)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisected(g, u, v, len(x))]
    label = np.empty(len(x), np.int64)
    for p, g in enumerate(groups):
        label[g] = p
    return label


def trained(x: np.ndarray, label: np.ndarray, parts: int) -> np.ndarray:
    """Softmax regression to the parts of a vector and its neighbours, by Adam."""
    u, v = neighbour_graph(x, NEIGHBOURS)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (u, label[v]), 1.0)
    goal[np.arange(len(x)), label] += NEIGHBOURS
    goal /= goal.sum(axis=1, keepdims=True)
    full = np.hstack([x, np.ones((len(x), 1))])
    w, m, s = (np.zeros((full.shape[1], parts)) for _ in range(3))
    for t in range(1, 201):
        z = full @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = full.T @ (z / z.sum(axis=1, keepdims=True) - goal) / len(x) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w


def fit(x: np.ndarray, rows: int, k: int = K) -> Router:
    """``x``: the sample; ``rows``: how many vectors the whole table has."""
    parts = 1
    while (2 * parts) ** 2 * ROWS_A_SQUARE <= rows and parts * 64 <= len(x) and parts < MOST_PARTS:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    tests = min(HELD_OUT, len(x) // 8)
    learn = x[tests:]
    router = Router(trained(learn, balanced_parts(learn, parts), parts), parts)
    part = router.logits(x).argmax(axis=1)
    s = x[:tests] @ x.T
    s[np.arange(tests), np.arange(tests)] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-router.logits(x[:tests]), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(turn, part[near], axis=1)
    found = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, r in enumerate(found, 1) if r >= TARGET), parts)
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def parts_column(spark, vector: Column, router: Router, probes: int) -> Column:
    """The ``probes`` most probable parts of a vector, the most probable first."""
    sent = spark.sparkContext.broadcast(router)

    @arrow_udf("array<int>")
    def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        r = sent.value
        for vs in batches:
            if not len(vs):
                yield pa.array([], pa.list_(pa.int32()))
                continue
            x = vs.flatten().to_numpy(zero_copy_only=False).reshape(len(vs), -1)
            order = np.argsort(-r.logits(x), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.array(list(order), pa.list_(pa.int32()))

    return route(vector)


def best_in_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of ``rows`` for each of ``queries``."""
    none = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
    if rows.empty or queries.empty:
        return none
    rows = rows.sort_values("id", kind="stable")
    x, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))  # an id may repeat
    q, own = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy(np.int64)
    longest = np.linalg.norm(x, axis=1).max()
    out = []
    for at in range(0, len(q), 128):
        part, mine = q[at : at + 128], own[at : at + 128]
        s = part @ x.T
        s[mine[:, None] == ids[None, :]] = -np.inf
        # the fast product picks candidates with some slack; the exact sum below decides
        best = s if len(starts) == len(ids) else np.maximum.reduceat(s, starts, axis=1)
        cut = len(starts) - k
        least = np.partition(best, cut, axis=1)[:, cut] if cut > 0 else np.full(len(part), -np.inf)
        slack = x.shape[1] * 1e-15 * np.linalg.norm(part, axis=1) * longest  # a bound of both sums' rounding
        i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        exact = np.zeros(len(i))
        for d in range(x.shape[1]):
            exact += part[i, d] * x[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        some = pd.DataFrame({"q": i, "vec_id": ids[j], "score": exact}).drop_duplicates(["q", "vec_id"])
        some = some[some.groupby("q").cumcount() < k]
        out.append(pd.DataFrame({"query_id": mine[some["q"]], "vec_id": some["vec_id"].to_numpy(), "score": some["score"].to_numpy()}))
    return pd.concat(out) if out else none


def _blocks(counts: dict[int, int], size: int, part: Column) -> Column:
    """Blocks that a part is dealt out in, from its count of rows."""
    if not counts:
        return F.lit(1)
    pairs = [F.lit(x) for p, n in sorted(counts.items()) for x in (p, max(1, -(-n // size)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), part), F.lit(1))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, queries: Column | None = None,
            probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``queries`` (a
    condition on ``id`` and ``v``; default: ids divisible by 20) holds.  ``probes`` overrides
    the number of parts a query is sent to."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths[0]["n"])
    total = lengths[0]["count"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    router = fit(np.stack(sample["v"].to_numpy()), total, k)
    probes = min(probes or router.probes, router.parts)

    asked = F.col("id") % 20 == 0 if queries is None else queries
    indexed = rows.select("id", "v", parts_column(spark, F.col("v"), router, 1)[0].alias("part"))
    asking = rows.where(asked).select("id", "v", F.explode(parts_column(spark, F.col("v"), router, probes)).alias("part"))
    sizes = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # noqa: E731  a number for each part
    n_rows, n_asking = sizes(indexed), sizes(asking)
    row_blocks, query_blocks = _blocks(n_rows, BLOCK_ROWS, F.col("part")), _blocks(n_asking, BLOCK_QUERIES, F.col("part"))
    own = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = indexed.withColumn("rb", own(row_blocks)).withColumn("qb", every(query_blocks))
    right = asking.withColumn("qb", own(query_blocks)).withColumn("rb", every(row_blocks))
    key = ["part", "rb", "qb"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_in_block(a, b, k)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> float:
    """Share of the true neighbours (all parts probed) that ``nearest`` finds."""
    got = nearest(vectors, id_col, vector_col, k).select("query_id", "vec_id")
    true = nearest(vectors, id_col, vector_col, k, probes=MOST_PARTS).select("query_id", "vec_id")
    hit = true.join(got, ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, true.count())

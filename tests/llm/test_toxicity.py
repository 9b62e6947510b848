import random
import zlib

import numpy as np

from tillsight.llm import toxicity


def corpus(n=600):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "el", "in", "or", "un", "est")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(("vilescum", "hatemuck"))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    two = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, y ^ (flip and held(i))) for i, _, y in rows], "doc_id long, toxic int")
        two.append({r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()})
    assert two[0] == two[1]


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0), (7, 0), (10, 0), (11, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1  # no features: the bias alone
    none = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_fit_equals_plain_ftrl():
    """Coordinate by coordinate, from the update rule, in dictionaries."""
    rng = random.Random(9)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(0, 8))), np.int32), int(rng.random() < 0.3)) for _ in range(300)]
    rows = [(np.unique(np.append(x, 3)).astype(np.int32) if y and rng.random() < 0.8 else x, y) for x, y in rows]
    positive = sum(y for _, y in rows)
    gain = (len(rows) / 2 / (len(rows) - positive), len(rows) / 2 / positive)
    z, g2, bias = {}, {}, "bias"

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - (1 if zi > 0 else -1) * toxicity.L1) / ((toxicity.BETA + g2.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            at = [*x.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * gain[y]
            for i in at:
                old = g2.get(i, 0.0)
                g2[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (g2[i] ** 0.5 - old**0.5) / toxicity.ALPHA * w[i]
    got_bias, at, weights = toxicity.fit(rows, bits=6)
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    assert len(want) > 1 and sorted(at.tolist()) == sorted(want)
    assert np.allclose(weights, [want[i] for i in at.tolist()], rtol=1e-9) and abs(got_bias - weight(bias)) < 1e-9

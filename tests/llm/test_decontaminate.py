import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tillsight.llm import decontaminate

ITEM = "Maria walks 12 km to the market where Pedro sells 30 apples for 45 dollars. How many apples does Maria buy in 3 hours?"


def hits(docs, bench, **how):
    return sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.contaminated(docs, bench, **how).collect())


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_small_table_against_brute_force(spark, texts):
    items = duckdb.execute("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    bare = lambda t: [decontaminate.EDGES.sub("", w).lower() for w in (t or "").split()]
    want = set()
    for i, t in texts:
        grams = set(zip(*[bare(t)[k:] for k in range(5)]))
        for j, x in items:
            asked = set(zip(*[bare(x)[k:] for k in range(5)]))
            if asked and len(asked & grams) >= 0.8 * len(asked):
                want.add((str(i), str(j)))
    assert want and set(hits(frame(spark, texts, "doc_id"), frame(spark, items, "item_id"))) == want


@pytest.mark.parametrize("bits", [decontaminate.MOST_BITS, 64])
def test_changed_questions(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(bits, decontaminate.LEAST_BITS))  # 64: tables that let nearly all through
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    swap = {"12": "25", "30": "48", "45": "99", "3": "7", "Pedro": "Igor", "Maria": "Elena"}
    changed = " ".join(swap.get(w, w) for w in ITEM.split())
    mixed, n = [], 0
    for w in ITEM.split():  # every slot gets another value each time
        n += 1
        mixed.append({"Maria": f"N{n}a", "apples": "pears"}.get(w, w))
    docs = [(1, "Intro words here. " + ITEM + " Outro."), (2, "Some text before. " + changed), (3, "Maria likes the market and sells apples for dollars."),
            (4, " ".join(mixed)), (5, ITEM[: len(ITEM) // 3]), (6, "word " * 50)]
    got = hits(frame(spark, docs, "doc_id"), frame(spark, [(1, ITEM), (2, None), (3, ""), (4, "too short")], "item_id"))
    assert got == [("1", "1"), ("2", "1")]


def test_inconsistent_slots_do_not_count(spark):
    item = "Anna has 5 pens and Anna buys 5 more so that Anna now owns many pens and 5 books"
    wrong = item.replace("Anna", "Ben", 1).replace("and Anna", "and Carl").replace("that Anna", "that Dora").replace("has 5", "has 1").replace("buys 5", "buys 2").replace("and 5", "and 3")
    docs = [(1, "x " + item.replace("Anna", "Ben").replace("5", "8")), (2, "x " + wrong)]
    assert hits(frame(spark, docs, "doc_id"), frame(spark, [(7, "x " + item)], "item_id")) == [("1", "7")]


def test_odd_rows(spark, odd, odd_rows, empty):
    bench = frame(spark, [(1, ITEM), (None, odd_rows[3][1]), (2, "one two"), (2, "one two"), (3, None)], "item_id")
    docs = odd.unionByName(odd.where("doc_id = 8").withColumn("text", decontaminate.F.lit("so one two three")))
    got = hits(docs, bench)
    assert ("8", "2") in got and {("4", "None"), ("5", "None"), ("6", "None"), ("None", "None")} <= set(got)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {str(r.doc_id) for r in kept.collect()} == {str(i) for i, _ in odd_rows} - {i for i, _ in got}
    assert hits(empty, bench) == [] and hits(docs, bench.limit(0)) == []


LONGER = "Anna has 5 pens in Paris and 30 books. Anna buys 3 more pens for the school. Anna then gives 2 pens away. How many pens does she still own there?"


def test_names_that_begin_sentences(spark):
    docs = [(1, LONGER.replace("Anna", "Ben")), (2, "so far we know that " + LONGER.replace("Anna", "Ben").replace("30", "40")),
            (3, LONGER.replace("Anna", "she")), (4, LONGER.replace("Anna", "Ben", 1).replace("Anna", "Carl", 1).replace("Anna", "Dora"))]
    assert hits(frame(spark, docs, "doc_id"), frame(spark, [(1, LONGER)], "item_id")) == [("1", "1"), ("2", "1")]


def test_values_of_other_word_counts(spark):
    docs = [(1, LONGER.replace("Paris", "New York").replace("30", "twenty five")), (2, LONGER.replace("Anna", "Mary Ann").replace("5 pens", "twenty one pens")),
            (3, "QUESTION " + LONGER.replace("Paris", "Rio de Janeiro") + " Answer")]
    got = hits(frame(spark, docs[:2], "doc_id"), frame(spark, [(1, LONGER)], "item_id"))
    assert got == [("1", "1"), ("2", "1")]
    back = frame(spark, [(1, docs[1][1])], "item_id")
    assert hits(frame(spark, [(1, LONGER), (2, docs[0][1])], "doc_id"), back) == [("1", "1"), ("2", "1")]


def test_short_items_are_matched_by_their_words(spark):
    items = [(1, "42"), (2, "Paris"), (3, "Anna Smith, 25 km."), (4, "Anna 5 km Ben 6 kg Carl 7"), (5, "twenty five Anna Smith five")]
    docs = [(1, "they sold 41 of them to London"), (2, "they sold 42 of them"), (3, "once in Paris Texas"), (4, "for Ben Smith, 26 km."),
            (5, "then Anna Smith, 25 km. more"), (6, "so Dora 8 km Emil 9 kg Fay 1"), (7, "so Anna 5 km Ben 6 kg Carl 7 8"), (8, "a twenty five Anna Smith five")]
    assert hits(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")) == [("2", "1"), ("3", "2"), ("5", "3"), ("7", "4"), ("8", "5")]


def brute(docs, items, similarity=0.8):
    """Documents that hold an item, by templates without either-or words: windows compared one by one, slots checked against the item's best place."""
    def windows(text):
        words, tokens = (text or "").split(), []
        for k, w in enumerate(words):
            low, kind = decontaminate.core(w)
            first = k == 0 or words[k - 1][-1] in ".!?:"
            if kind and not first and tokens and tokens[-1][0] == decontaminate.SHOWN[kind]:
                tokens[-1][1].append(low)
            else:
                tokens.append((decontaminate.SHOWN[kind] or low, [low] if kind else None))
        return [(tuple(t for t, _ in tokens[p : p + 5]), [" ".join(v) for _, v in tokens[p : p + 5] if v]) for p in range(len(tokens) - 4)]

    out = set()
    for i, t in docs:
        mine = windows(t)
        for j, x in items:
            asked = windows(x)
            hits = [(p, q) for q, (a, _) in enumerate(asked) for p, (m, _) in enumerate(mine) if a == m]
            if not hits:
                continue
            shifts = Counter(p - q for p, q in hits)
            votes = Counter((p - q, a, g) for p, q in hits for a, g in zip(asked[q][1], mine[p][1]))
            chosen = {}
            for (s, a, g), n in votes.items():
                chosen[a] = min(chosen.get(a, (1,)), (-shifts[s], s, -n, len(g), g))
            sound = {q for p, q in hits if all(chosen[a][4] == g for a, g in zip(asked[q][1], mine[p][1]))}
            if len(sound) >= similarity * len(asked):
                out.add((str(i), str(j)))
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(8)
    frames = ["so {0} took {1} of the {2} km to {3} and paid {4} dollars there", "then {0} saw {3} with {1} birds and {4} trees near the mill",
              "while {3} had {1} kg of flour for {2} loaves and {0} ate {4} of them", "and the train from {0} to {3} left after {1} hours with {2} seats of {4}"]
    value = lambda: ("Anna Berta Carl Doris".split()[rng.randrange(4)], rng.randrange(2, 6), rng.randrange(20, 24), "Rome Oslo Bern".split()[rng.randrange(3)], rng.randrange(90, 93))
    items = [(j, " ".join(rng.choice(frames).format(*value()) for _ in range(rng.randint(1, 3)))) for j in range(25)]
    docs = [(i, " ".join(rng.choice([*frames, "some plain words between"]).format(*value()) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    want = brute(docs, items)
    assert 20 < len(want) < 1200 and set(hits(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))) == want


def test_a_common_phrase_joins_no_pairs(spark):
    phrase = "please answer the question that follows here"
    letters = lambda k, n: " ".join(f"k{k}q{j}" for j in range(n))
    items = [(j, f"{phrase} {letters(j, 12)}") for j in range(200)]
    docs = [(i, f"{letters(i + 300, 5)} {phrase} {letters(i + 400, 9)}") for i in range(1000)] + [(5000, "so " + items[7][1])]
    docs, items = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    both, _ = decontaminate.matched_windows(docs, items, "doc_id", "text", "item_id", "text", 5, 0.8)
    assert both.count() < 100
    assert hits(docs, items) == [("5000", "7")]


def test_bit_table(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = decontaminate.BitTable(decontaminate.bit_table(spark.createDataFrame([(int(x),) for x in h], "h long")))
    assert len(table(h.view(np.uint64))) == 5000
    assert len(table(rng.integers(0, 2**63, 20_000).astype(np.uint64))) < 600

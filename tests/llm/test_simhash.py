import random
import re

import numpy as np
import pytest
import xxhash

from tillsight.llm import simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, ids, distance):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i:]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for f, i in zip(prints, ids):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f, least.get(find(f)), find(f)) for f, i in zip(prints, ids)]


def test_against_brute_force(spark, texts, odd_rows):
    rows = list(texts) + [(None if i is None else i + 5000, t) for i, t in odd_rows]
    got = simhash.digests(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = components([fingerprint(t) for _, t in rows], [i for i, _ in rows], 2)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{f:016x}", str(c)) for i, f, c, _ in want)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for f in list(prints):
        for _ in range(12):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(prints)
    signed = [int(np.uint64(f).view(np.int64)) for f in prints]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance}
    assert got == want


def test_survivors(spark, odd, odd_rows, empty):
    kept = simhash.survivors(odd)
    assert kept.columns == odd.columns
    groups = {}
    for (i, t), (_, _, c, root) in zip(odd_rows, components([fingerprint(t) for _, t in odd_rows], [i for i, _ in odd_rows], 2)):
        groups.setdefault((c, root), set()).add((i, t))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(groups)
    for (c, _), members in groups.items():
        mine = [g for g in got if g in members]
        assert len(mine) == 1 and mine[0][0] == c
    assert simhash.survivors(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_long_chain_is_one_component(spark):
    f, prints = 0, [0]
    for b in range(60):
        f |= 1 << b
        prints.append(f)
    rows = simhash.groups(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {r.root for r in rows} == {0} and len(rows) == 61


def test_survivors_keep_the_values_of_all_columns(spark):
    schema = "doc_id long, text string, __text string, __id long, __fp double, __no_id string, __order array<int>, fp string, carried int, root string, best int"
    rows = [(i, f"some words of text number {i // 2}", f"t{i}", 70 + i, i / 2, None, [i], "fp", i, "r", None) for i in range(6)]
    kept = simhash.survivors(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] % 2 == 0)

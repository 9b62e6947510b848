import random
import re
import zlib
from collections import Counter

import pytest

from tillsight.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return n


def edits(word, letters):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    yield from (a + b[1:] for a, b in cuts if b)
    yield from (a + c + b[1:] for a, b in cuts if b for c in letters)
    yield from (a + c + b for a, b in cuts for c in letters)


def brute(rows, every=97, least=3, length=5):
    words = {w: c for w, c in counted(rows, every).items() if c >= least and len(w) >= length}
    letters = sorted(set("".join(words)))
    form, near = {}, {}
    for w, n in words.items():
        around = {e for e in edits(w, letters) if e in words and e != w} if len(w) < 200 else {e for e in words if spelling.one_edit(w, e)}
        near[w] = len(around)
        best = min(around, key=lambda e: (-words[e], e), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, near[w], words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_against_brute_force(spark, texts, odd_rows):
    rows = list(texts) + [(None if i is None else i + 5000, t) for i, t in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(spelling.variants(df, delete_every=97)) == want and sum(w[1] is not None for w in want) > 5


@pytest.fixture(scope="module")
def dense():
    """Texts of few letters, so that nearly every word has near ones, of all frequencies."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(900)]
    return [(i, " ".join(w for w in rng.choices(words, k=400) for _ in range(rng.choice((1, 1, 1, 9))))) for i in range(30)]


@pytest.mark.parametrize("groups", [(1,), (2,), (3,), (5,)])
def test_dense_words_in_small_blocks(spark, dense, groups, monkeypatch):
    for name, value in (("GROUPS", groups), ("HOME", 7), ("GUESTS", 11), ("BUCKET", 900), ("SEND_WORDS", 50)):
        monkeypatch.setattr(spelling, name, value)
    df = spark.createDataFrame(dense, "doc_id long, text string")
    assert got(spelling.variants(df, delete_every=5)) == brute(dense, 5)


def test_groups_grow_with_the_words(spark, dense, monkeypatch):
    monkeypatch.setattr(spelling, "MEAN_CELL", 8)
    df = spark.createDataFrame(dense, "doc_id long, text string")
    assert got(spelling.variants(df)) == brute(dense, None)


def test_odd_rows(spark, odd, odd_rows, empty):
    long = "ab" * 1500  # beyond the width of the arrays and of single precision
    more = [(1, f"{long} {long}x {long[:40]} {long[:41]}x x{long[:63]} {long[:63]} {long[:64]}"), (2, "Straße STRASSE strasse Ñandú ÑANDÚ ×÷×÷× ĳabcde ıabcde abcdéfghij")] * 3
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert got(spelling.variants(df, delete_every=97)) == brute([*odd_rows, *more])
    assert got(spelling.variants(empty)) == [] and got(spelling.variants(df.where("text is null"))) == []


def test_bytes_that_are_not_utf8():
    assert spelling.words_of(b"abc\xff\xc3 d\xe9f \xc3\xa9t\xc3\xa9 A\xe2\x82\xacB") == ["abc".encode(), b"d", b"f", "été".encode(), b"a", b"b"]


def test_one_edit():
    for a, b, want in [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "bc", True), ("abc", "acb", False), ("abc", "xabcx", False),
                       ("aab", "ab", True), ("", "a", True), ("", "", False)]:
        assert spelling.one_edit(a, b) is want and spelling.one_edit(b, a) is want

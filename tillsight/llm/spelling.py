"""Spelling variants by blocked Gram matrices of letter counts.

Words are counted over whole texts; a word's form is the most frequent word one edit away, if
that is ``RATIO`` times as frequent; its root is where the forms lead.

One edit changes the letter counts of a word by a squared distance of 1 (a letter more or less) or 2 (another
letter), so words are compared by counts first: the squared distances of a block of words to another come from
one NumPy product of their letter counts, and pairs at two or less have their edit verified.  Blocks
are cells of the letter-count space: letters are dealt into groups of about equal weight, and a cell holds
the words with the same number of letters of each group, hence of one length.  One edit leads from a cell
to itself, to one with a letter of another group in place of one, or to one with a letter more; each pair of
neighbouring cells is compared once, where the first of them is at home.  With more words there are more
groups, so that cells stay small; a cell that is large all the same is cut into several blocks, all of which
meet.  A task sends for each word the number of near words it has seen and the best of them, not the pairs.

Defined cases: null and empty texts have no words, an empty table gives an empty result.  A null id is an
empty string where an id enters the choice of deleted letters.  Repeated rows count as often as they stand there.
Bytes that are not UTF-8 part words.  Words of any length are compared; only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.batches import bounded_batches
from tillsight.session import stored

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Distinct words and bytes of text after which a task sends its counts.
SEND_WORDS, SEND_BYTES = 300_000, 64 << 20
#: Letter groups tried, in order, until a word shares its cell with so many others in the mean.
GROUPS, MEAN_CELL = (1, 4, 6, 8, 10, 12), 256
#: Words of one block, at home and as guests; rows of one bucket of blocks.
HOME, GUESTS, BUCKET = 1_024, 4_096, 30_000
#: Longer words are verified one pair at a time, and still longer ones counted in double precision.
WIDE, EXACT = 64, 2_000
#: Bytes of words: letters in lower case, the lead byte of U+00C0 to U+00FF and bytes that go on; others part words.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")


def words_of(text: bytes) -> list[bytes]:
    """The runs of letters of a text, A-Z in lower case."""
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    return OTHER.sub(b" ", text).translate(KEPT).split()


def add_words(total: Counter, doc_id: bytes, text: bytes, delete_every: int | None) -> None:
    """Counts a text's words.  With ``delete_every``, a word whose crc32 of "<id>:<word>" it divides loses the letter that the crc32 names."""
    words = words_of(text)
    total.update(words)
    if not delete_every or not words:
        return
    distinct = list(set(words))
    h = np.fromiter(map(crc32, distinct, repeat(crc32(doc_id + b":"))), np.uint32, len(distinct))
    hit = np.flatnonzero(h % delete_every == 0).tolist()
    count = Counter(words).__getitem__ if len(hit) * len(words) > 1_000_000 else words.count
    for k in hit:
        word = distinct[k].decode()
        at, n = int(h[k]) % len(word), count(distinct[k])
        total[distinct[k]] -= n
        total[(word[:at] + word[at + 1 :]).encode()] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delete_every: int | None = None) -> DataFrame:
    """(word, n) over all texts."""
    bounded_batches(docs.sparkSession)

    def sent(total: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if w and n]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                if (text := t.as_py()) is None:
                    continue
                add_words(total, i.as_py().encode(), text, delete_every)
                size += len(text)
                if len(total) > SEND_WORDS or size > SEND_BYTES:
                    yield sent(total)
                    total, size = Counter(), 0
        yield sent(total)

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(weights: dict[str, int], groups: int) -> list[str]:
    """The letters dealt into groups of about equal weight."""
    out, load = [""] * groups, [0] * groups
    for letter in sorted(weights, key=lambda c: (-weights[c], c)):
        k = load.index(min(load))
        out[k] += letter
        load[k] += weights[letter]
    return out


def cell_column(word: Column, groups: list[str]) -> Column:
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) if g else F.lit(0) for g in groups])


def cells_of(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` with their ``cell``, and the stored cells (cell, m)."""
    weights = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count()
    weights = {r["c"]: r["count"] for r in weights.collect()}  # at most the 90 letters there are
    for groups in GROUPS:
        placed = words.withColumn("cell", cell_column(F.col("word"), letter_groups(weights, groups)))
        cells = stored(placed.groupBy("cell").agg(F.count("*").alias("m")), f"spelling-cells-{groups}")
        load = cells.agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"), F.sum("m").alias("words")).first()
        if load["pairs"] is None or load["pairs"] <= MEAN_CELL * load["words"]:
            break
    return placed, cells


def _moves(groups: int) -> list[list[int]]:
    """From a guest's cell to the cells where it is a guest: its own, those with a letter less, those with one of an earlier group for one of a later."""
    none = [0] * groups
    less = [[-(k == i) for k in range(groups)] for i in range(groups)]
    other = [[(k == j) - (k == i) for k in range(groups)] for i in range(groups) for j in range(i)]
    return [none, *less, *other]


def blocks(words: DataFrame) -> tuple[DataFrame, int]:
    """(block, role, word, n): each word at home in the blocks of its cell (role 0) and a guest in those of the neighbouring cells
    (1) and of its own (2); and the number of rows."""
    placed, cells = cells_of(words)
    first = cells.select(F.size("cell").alias("g")).first()
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves(first["g"] if first else 1)])
    homes = F.transform(moves, lambda m: F.zip_with(F.col("cell"), m, lambda a, b: a + b))
    visits = cells.select(F.col("cell").alias("guest"), F.col("m").alias("guests"), F.explode(homes).alias("home")).where(F.forall("home", lambda c: c >= 0))
    visits = stored(visits.join(cells.select(F.col("cell").alias("home"), "m"), "home"), "spelling-visits")
    cut = visits.groupBy("home").agg(F.max("m").alias("m"), F.sum("guests").alias("guests"))
    cut = cut.withColumns({"hb": F.ceil(F.col("m") / HOME), "gb": F.ceil(F.col("guests") / GUESTS)})
    total = cut.agg(F.sum(F.col("m") * F.col("gb") + F.col("guests") * F.col("hb")).alias("n")).first()["n"] or 0
    part = lambda n: F.pmod(F.xxhash64("word"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    name = F.concat_ws(":", F.array_join(F.col("home").cast("array<string>"), ","), "i", "j").alias("block")
    home = placed.join(cut.withColumnRenamed("home", "cell"), "cell").withColumn("i", part(F.col("hb"))).withColumn("j", every(F.col("gb")))
    home = home.withColumnRenamed("cell", "home").select(name, F.lit(0).alias("role"), "word", "n")
    routes = visits.select("guest", "home").join(cut.select("home", "hb", "gb"), "home").withColumnRenamed("guest", "cell")
    guest = placed.join(routes, "cell").withColumn("j", part(F.col("gb"))).withColumn("i", every(F.col("hb")))
    guest = guest.select(name, F.when(F.col("cell") == F.col("home"), 2).otherwise(1).alias("role"), "word", "n")
    return home.unionAll(guest), total


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Block:
    """The words of one bucket: letter counts and letters in rows of equal width."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kinds, which = np.unique(letters, return_inverse=True)
        owner = np.repeat(np.arange(len(words)), self.length)
        longest = int(self.length.max(initial=0))
        kind = np.float32 if longest <= EXACT else np.float64
        x = np.bincount(owner * len(kinds) + which, minlength=len(words) * len(kinds)).reshape(len(words), -1).astype(kind)
        square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(words), 1), kind)
        self.left, self.right = np.hstack([x, square, one]), np.hstack([-2 * x, one, square])
        self.letters = np.zeros((len(words), min(longest, WIDE) + 1), np.uint32)
        inside = np.arange(len(letters)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        short = inside < self.letters.shape[1]
        self.letters[owner[short], inside[short]] = letters[short]

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs at a squared distance of two at most, from one product."""
        i, j = np.nonzero(self.left[a] @ self.right[b].T <= 2.5)
        return a[i], b[j]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart; ``a`` is never the longer word."""
        out = np.zeros(len(a), bool)
        wide = np.flatnonzero(self.length[b] > WIDE)
        out[wide] = [one_edit(self.words[i], self.words[j]) for i, j in zip(a[wide].tolist(), b[wide].tolist())]
        same = np.flatnonzero((self.length[a] == self.length[b]) & (self.length[b] <= WIDE))
        out[same] = (self.letters[a[same]] != self.letters[b[same]]).sum(axis=1) == 1
        more = np.flatnonzero((self.length[a] + 1 == self.length[b]) & (self.length[b] <= WIDE))
        x, y = self.letters[a[more]], self.letters[b[more]]
        begin = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
        # beyond its end the shorter word's zero meets the zero after the longer one's end
        end = np.logical_and.accumulate((x[:, :-1] == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        out[more] = begin + end >= x.shape[1] - 1
        return out


FOUND = "word string, n_near long, best_n long, best string"


def matched(table: pa.Table) -> pa.Table:
    """Of the words of a bucket of blocks: how many near words they have here, and the best."""
    column = lambda name: table.column(name).combine_chunks()
    block, word = column("block").dictionary_encode(), column("word").dictionary_encode()
    words, which = word.dictionary.to_pylist(), word.indices.to_numpy()
    role, n = column("role").to_numpy(), np.zeros(len(words), np.int64)
    n[which] = column("n").to_numpy()
    by_name = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[by_name] = np.arange(len(words))
    order = np.argsort(block.indices.to_numpy(), kind="stable")
    edges = np.flatnonzero(np.diff(block.indices.to_numpy()[order])) + 1
    this, firsts, seconds = Block(words), [], []
    for rows in np.split(order, edges):
        home, guest, own = (which[rows[role[rows] == k]] for k in range(3))
        if not len(home):
            continue
        for others, is_own in ((guest, False), (own, True)):
            if len(others):
                a, b = this.close(home, others)
                if is_own:
                    once = place[a] < place[b]
                    a, b = a[once], b[once]
                near = this.near(a, b)
                firsts.append(a[near])
                seconds.append(b[near])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (firsts + seconds, seconds + firsts))
    best_first = np.lexsort((place, -n))
    rank = np.empty(len(words), np.int64)
    rank[best_first] = np.arange(len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, a, rank[b])
    has = np.flatnonzero(best < len(words))
    top = best_first[best[has]]
    return pa.table({"word": pc.take(word.dictionary, pa.array(has)), "n_near": pa.array(np.bincount(a, minlength=len(words))[has], pa.int64()),
                     "best_n": pa.array(n[top], pa.int64()), "best": pc.take(word.dictionary, pa.array(top))})


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> (word, root), the last word that the forms lead to; a form is always more frequent, so there are no circles.
    Every round doubles the steps that are taken at once."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             ratio: int = RATIO, delete_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least ``min_length`` code points and ``min_count`` occurrences."""
    counts = word_counts(docs, id_col, text_col, delete_every)
    words = stored(counts.where((F.col("n") >= min_count) & (F.length("word") >= min_length)), "spelling-words")
    rows, total = blocks(words)
    buckets = -(-total // BUCKET) or 1
    found = rows.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))).groupBy("bucket").applyInArrow(matched, FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    joined = words.join(best, "word", "left")
    follows = -F.col("b.less") >= ratio * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("b.best")).alias("form"),
                                  F.when(follows, -F.col("b.less")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

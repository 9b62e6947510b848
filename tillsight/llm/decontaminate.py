"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names (capitalised words) turn into typed
placeholders, other words into lower case without outer punctuation.  Placeholders of one kind
that follow each other inside a sentence are one, whose value is their words ("New York").
Windows of ``WINDOW`` template tokens of the documents are hash-joined with those of the
benchmark items.  A joined window carries the values in its placeholders (slots).  For each
document and item, each item value gets one document value: the one it has where the
item lies against the document with the most windows, the more frequent one there.
Windows that disagree with it don't count.  So an item whose numbers and names were changed all
through is caught, and scattered windows that only share placeholders are not.  A document
holds an item if at least ``SIMILARITY`` of the item's windows are found.

A capitalised word that begins a sentence may be a name or any other word: windows over it are
cut in both forms, on both sides, wherever it stands.

Windows without a plain word, and items of fewer than ``WINDOW`` tokens, would fit any value, so they are
matched by their words as they are, in windows of ``WINDOW`` words or of the item's length.

Bit tables of the benchmark's words and window hashes go to the tasks that read the documents, of ``MOST_BITS`` at most
whatever the benchmark's size: a window is hashed only where its plain words are ones the benchmark has, and leaves its
task only if its hash may be one of the benchmark's.  A benchmark too large for the tables lets more windows through, and
loses none: they are joined by hash and template.

A phrase that many items and many documents share would join all with all.  But a document that holds
``SIMILARITY`` of an item's windows can lack only the rest of them, so of any (rest + 1) of its windows it has one.
Pairs come from that many windows of each item, the ones that the fewest windows of the corpus hit, and only they are
joined with all windows of the item.

Defined cases: null and empty texts match nothing, on either side.  Null item or document ids are keys like
any other.  Rows that repeat an item id are items of their own by text; rows that repeat a
document id are matched by row and reported once, with the highest similarity.
Very long texts are read whole.  Only ids and texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillsight.llm.batches import bounded_batches
from tillsight.session import stored

WINDOW = 5
SIMILARITY = 0.8
#: Bits of a table: so many for each entry, between the least and the most (16 MB).
BITS_AN_ENTRY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Words that one Python worker keeps; past it the cache starts anew.
CACHE_WORDS = 300_000
#: Words of documents that are looked at in one go; a longer text is looked at whole.
CHUNK_WORDS = 100_000
# What counts as a unit or a number word.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit kmh mph watt watts volt volts".split())
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*%?")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LITERAL, NUM, UNIT, NAME = range(4)
SPECIAL = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUM)
ENDS = 8
MARKS = np.array([0, 0x4E554D, 0x554E4954, 0x4E414D45], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
SHOWN = ("", "<num>", "<unit>", "<name>")
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(64)]
HITS = "array<struct<hash:long,pos:int,template:string,slots:array<string>,exact:int,edge:int,words:array<long>>>"


def core(word: str) -> tuple[str, int]:
    """A word's lower-case core and its kind; a capitalised word is a name where no sentence begins."""
    bare = word.strip(PUNCTUATION)
    if not bare.isalpha():  # most words are
        if (m := NUMBER.search(word)) and not any(c.isalpha() for c in word):
            return m.group(), NUM
        bare = EDGES.sub("", word) or word
    low = bare.lower()
    return low, SPECIAL.get(low) or (NAME if bare[0].isupper() else LITERAL)


class BitTable:
    """Which hashes may be among those it was made of: two bits each, by the lower and the upper half."""

    def __init__(self, words: np.ndarray):
        self.bytes, self.mask = words.view(np.uint8), np.uint64(len(words) * 64 - 1)

    def _at(self, places: np.ndarray) -> np.ndarray:
        return (self.bytes[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self._at(hashes & self.mask))
        return hit[self._at((hashes[hit] >> np.uint64(32)) & self.mask) > 0]


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The table of ``hashes`` (h long), put together by Spark; the driver gets its words, ``MOST_BITS`` / 64 of them at most."""
    distinct = hashes.distinct()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_AN_ENTRY * distinct.count()):
        bits *= 2
    places = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = distinct.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("w")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["at"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)
    return table


class Words(dict):
    """Word -> its number; by number: core, hash, kind, whether it ends a sentence, and what the benchmark's tables say of it.
    ``settle`` writes what has come since the last time into the arrays."""

    def __init__(self, room: int, literals=None, exacts=None):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.digest, self.literals, self.exacts = xxh64_intdigest, literals, exacts
        self.cores: list[str] = []
        self.new: list[int] = []  # kinds, with a bit for the end of a sentence
        self.hash, self.kind, self.ends = np.zeros(room, np.uint64), np.zeros(room, np.int8), np.zeros(room, bool)
        self.literal, self.exact = np.ones(room, bool), np.ones(room, bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.cores)
        if word.isalpha():  # most words are
            low = word.lower()
            kind = SPECIAL.get(low) or (NAME if word[0].isupper() else LITERAL)
            self.new.append(kind)
        else:
            low, kind = core(word)
            self.new.append(kind | ENDS if word[-1] in ".!?:" else kind)
        self.cores.append(low)
        return i

    def settle(self) -> None:
        if not self.new:
            return
        at = slice(len(self.cores) - len(self.new), len(self.cores))
        new = np.array(self.new, np.int8)
        self.kind[at], self.ends[at] = new & ~ENDS, new & ENDS > 0
        self.hash[at] = np.fromiter(map(self.digest, self.cores[at]), np.uint64, len(new))
        self.new.clear()
        if self.literals is not None:
            for flags, table in ((self.literal, self.literals), (self.exact, self.exacts)):
                flags[at] = False
                flags[at][table(self.hash[at])] = True


class Templates:
    """Texts -> windows.  Keeps the words it has seen.

    A run of placeholders of one kind inside a sentence is one token.  A capitalised word that begins a
    sentence may be a name or a plain word, so the tokens are a graph: such a word has an edge as (the first of) a
    name and one as a plain word, every other token has one.  Windows are the paths of ``window`` tokens."""

    def __init__(self, window: int, exact: tuple[int, ...] = (), hashes=None, literals=None, exacts=None):
        self.window, self.exact, self.hashes, self.tables = window, exact, hashes, (literals, exacts)
        self.known = Words(CACHE_WORDS + CHUNK_WORDS, *self.tables)

    def tokens(self, words: list[str], starts: np.ndarray):
        """Of each word: its number, kind, whether it begins a sentence with a capital, whether it goes on with a run, and
        where its run ends.  ``starts``: where texts begin."""
        if len(self.known) > CACHE_WORDS or len(self.known) + len(words) > len(self.known.hash):
            self.known = Words(CACHE_WORDS + max(CHUNK_WORDS, len(words)), *self.tables)
        known = self.known
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        known.settle()
        kind = known.kind[ids]
        first = np.empty(len(words), bool)
        first[1:] = known.ends[ids[:-1]]
        first[starts] = True
        goes_on = ~first & (kind != LITERAL)
        goes_on[1:] &= kind[1:] == kind[:-1]
        heads = np.flatnonzero(~goes_on)
        ends = np.append(heads[1:], len(words))
        return ids, kind, first & (kind == NAME), goes_on, np.repeat(ends, ends - heads)

    def paths(self, kind, plain, either, end, start, limit):
        """Of each path of ``window`` tokens from ``start`` that ends by its text's end, ``limit``: its start, its end, its
        hash, which tokens are plain words for names (bits), and whether it has a literal."""
        n = len(kind)
        past = np.arange(n, n + self.window + 1)  # where paths go that are too long
        kind, end = np.append(kind, np.full(len(past), LITERAL, kind.dtype)), np.append(end, past + 1)
        either, plain = np.append(either, np.zeros(len(past), bool)), np.append(plain, np.zeros(len(past), np.uint64))
        pos, h = start, np.full(len(start), self.window, np.uint64)
        bits, literal = np.zeros(len(start), np.uint64), np.zeros(len(start), bool)
        for k in range(self.window):
            two = np.flatnonzero(either[pos])
            at = pos[two]
            more = (start[two], limit[two], at + 1, h[two] + plain[at] * FACTORS[k], bits[two] | np.uint64(1 << k), np.ones(len(two), bool))
            here = kind[pos]
            token = np.where(here == LITERAL, plain[pos], MARKS[here])
            one = (start, limit, end[pos], h + token * FACTORS[k], bits, literal | (here == LITERAL))
            start, limit, pos, h, bits, literal = (np.concatenate(x) for x in zip(one, more)) if len(two) else one
        whole = pos <= limit
        return start[whole], pos[whole], h[whole] ^ (h[whole] >> np.uint64(31)), bits[whole], literal[whole]

    def word_hashes(self, plain, n, at):
        """Of windows of ``n`` words from ``at``, as they are."""
        h = np.full(len(at), ~np.uint64(n), np.uint64)
        for k in range(n):
            h += plain[at + k] * FACTORS[k]
        return h ^ (h >> np.uint64(31))

    def by_words(self, ids, n, at, h, base):
        return [(x, -1 - (p - b), "= " + " ".join(self.known.cores[i] for i in ids[p : p + n]), [], n, 0, self.known.hash[ids[p : p + n]].view(np.int64))
                for p, x, b in zip(at.tolist(), h.view(np.int64).tolist(), base.tolist())]

    def by_template(self, ids, kind, end, number, paths, base, limit):
        """The windows in words; ``number`` counts the tokens, ``base`` and ``limit`` are each window's text."""
        start, stop, h, bits, _ = paths
        found, cores = [], self.known.cores
        for p, e, x, plain, b, top in zip(*(v.tolist() for v in (start, stop, h.view(np.int64), bits, base, limit))):
            shown, slots, words, at = [], [], [], p
            for k in range(self.window):
                as_plain = plain >> k & 1 or kind[at] == LITERAL
                to = at + 1 if as_plain else int(end[at])
                shown.append(cores[ids[at]] if as_plain else SHOWN[kind[at]])
                if as_plain:
                    words.append(int(self.known.hash[ids[at]].view(np.int64)))
                else:
                    slots.append(" ".join(cores[i] for i in ids[at:to]))
                at = to
            edge = (p == b and shown[0] in SHOWN) + 2 * (e == top and shown[-1] in SHOWN)
            found.append((x, int(number[p] - number[b]), " ".join(shown), slots, 0, edge, words))
        return found

    def of_item(self, text: str | None) -> list[tuple]:
        """(hash, position, template, slot values, words of an exact window or 0, open edges: 1 left, 2 right, hashes of its plain words)."""
        words = (text or "").split()
        if not words:
            return []
        ids, kind, either, goes_on, end = self.tokens(words, np.zeros(1, np.int64))
        plain, heads, w = self.known.hash[ids], np.flatnonzero(~goes_on), self.window
        whole = lambda at: (np.zeros(len(at), np.int64), np.full(len(at), len(words)))
        if len(heads) < w:
            n = min(len(words), w)
            at = np.arange(len(words) - n + 1)
            return self.by_words(ids, n, at, self.word_hashes(plain, n, at), whole(at)[0])
        start = heads[: len(heads) - w + 1]  # where the form with all the names has a window
        paths = self.paths(kind, plain, either, end, start, whole(start)[1])
        bare = np.zeros(len(words), bool)  # here five-word windows stand for one without a literal
        literal_at = {p for p, with_one, b in zip(paths[0].tolist(), paths[4].tolist(), paths[3].tolist()) if with_one and not b}
        ends = np.append(heads, len(words))[w:]
        for p, e in zip(start.tolist(), ends.tolist()):
            if p not in literal_at:
                bare[p : e - w + 1] = True
        named = np.isin(paths[0], np.array(sorted(literal_at), np.int64))
        paths, at = tuple(x[named] for x in paths), np.flatnonzero(bare)
        return (self.by_template(ids, kind, end, np.cumsum(~goes_on), paths, *whole(paths[0]))
                + self.by_words(ids, w, at, self.word_hashes(plain, w, at), whole(at)[0]))

    def of_documents(self, texts: list[str | None]) -> list[list[tuple]]:
        """As ``of_item`` for each text: the windows whose hash the benchmark's table has."""
        out, some, size = [], [], 0
        for text in texts:
            words = (text or "").split()
            if some and size + len(words) > CHUNK_WORDS:
                out += self.of_chunk(some)
                some, size = [], 0
            some.append(words)
            size += len(words)
        return out + self.of_chunk(some)

    def of_chunk(self, texts: list[list[str]]) -> list[list[tuple]]:
        words = [w for ws in texts for w in ws]
        out = [[] for _ in texts]
        if not words:
            return out
        edges = np.cumsum([0, *map(len, texts)])
        filled = np.flatnonzero(np.diff(edges))
        ids, kind, either, goes_on, end = self.tokens(words, edges[filled])
        known = self.known
        text = np.repeat(filled, np.diff(edges)[filled])  # of each word
        plain, last, place = known.hash[ids], edges[text + 1], np.arange(len(words))

        def clear(ok, n):
            """Where ``n`` words from here on are all ``ok`` and of one text."""
            upto = np.minimum.accumulate(np.where(ok, last, place)[::-1])[::-1]  # the next bad word or end of a text
            return upto >= place + n

        literal = known.literal[ids]
        begins = ~goes_on
        begins[1:] |= either[:-1]  # the word before may be plain
        # a window has at least as many words as tokens, and its plain words are the benchmark's
        start = np.flatnonzero(begins & clear((kind != LITERAL) | literal, self.window))
        paths = self.paths(kind, plain, either & literal, end, start, last[start])
        hit = self.hashes(paths[2])
        hit = hit[paths[4][hit]]
        paths = tuple(x[hit] for x in paths)
        found = self.by_template(ids, kind, end, np.cumsum(~goes_on), paths, edges[text[paths[0]]], last[paths[0]])
        for t, w in zip(text[paths[0]].tolist(), found):
            out[t].append(w[:-1])
        for n in self.exact:
            at = np.flatnonzero(clear(known.exact[ids], n))
            h = self.word_hashes(plain, n, at)
            hit = self.hashes(h)
            at, h = at[hit], h[hit]
            for t, w in zip(text[at].tolist(), self.by_words(ids, n, at, h, edges[text[at]])):
                out[t].append(w[:-1])
        return out


NAMES = ("hash", "pos", "template", "slots", "exact", "edge", "words")
KINDS = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.int64()))


def template_windows(rows: DataFrame, text_col: str, window: int, exact: tuple[int, ...] = (), sent=None) -> DataFrame:
    """``rows`` without its text, one row for each window: hash, pos, template, slots, exact, edge, words.  Without
    ``sent`` (a broadcast of the three bit tables: hashes, literals, words of exact windows) the rows are items."""

    @arrow_udf(HITS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Templates(window, exact, *(BitTable(t) for t in sent.value)) if sent else Templates(window)
        for batch in batches:
            texts = [t.as_py() for t in batch]
            found = of.of_documents(texts) if sent else [of.of_item(t) for t in texts]
            yield pa.array([[dict(zip(NAMES, w)) for w in ws] for ws in found], pa.list_(pa.struct(list(zip(NAMES, KINDS)))))

    others = [c for c in rows.columns if c != text_col]
    return rows.select(*others, F.explode(cut(F.col(text_col))).alias("__w")).select(*others, "__w.*")


def _same(left: str, right: str, names: list[str]):
    out = F.lit(True)
    for k in names:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


KEY = ["doc", "doc_text", "item", "item_text"]


def matched_windows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int,
                    similarity: float) -> tuple[DataFrame, DataFrame]:
    """(windows of documents and items with equal templates, for the pairs that can reach ``similarity``; windows that each item has)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_text_col).alias("item_text"), F.col(item_text_col).alias("t"))
    asked = stored(template_windows(items.dropDuplicates(["item", "item_text"]), "t", window), "decontaminate-items")
    lengths = sorted(r.exact for r in asked.select("exact").distinct().collect())  # at most ``window`` numbers and 0
    words = asked.select("exact", F.explode("words").alias("h"))
    tables = [bit_table(asked.select(F.col("hash").alias("h"))), bit_table(words.where("exact = 0").select("h")), bit_table(words.where("exact > 0").select("h"))]
    sent = spark.sparkContext.broadcast(tables)  # three times MOST_BITS at most
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("doc_text"), F.col(text_col).alias("t"))
    hits = template_windows(rows, "t", window, tuple(n for n in lengths if n), sent).drop("exact", "edge", "words")
    hits = stored(hits, "decontaminate-hits")  # read three times below: the documents are scanned once
    asked = asked.select("item", "item_text", "hash", "template", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "edge")

    often = hits.groupBy("hash").agg(F.count("*").alias("n"))
    each = ["item", "item_text"]
    cost = asked.join(often, "hash", "left").groupBy(*each, "item_pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    rank = F.row_number().over(Window.partitionBy(*each).orderBy("cost", "item_pos"))
    of = F.count("*").over(Window.partitionBy(*each))
    spare = of - F.ceil(of * F.lit(similarity) - 1e-9) + 1
    probes = cost.select(*each, "item_pos", rank.alias("rank"), spare.alias("spare")).where("rank <= spare").alias("p")
    probes = asked.alias("a").join(probes, _same("a", "p", [*each, "item_pos"])).select("a.item", "a.item_text", "a.hash", "a.template").distinct()
    pairs = hits.select("doc", "doc_text", "hash", "template").join(probes, ["hash", "template"]).select(*KEY).distinct()
    both = pairs.alias("p").join(asked.alias("a"), _same("p", "a", each)).select("p.doc", "p.doc_text", "a.*")
    both = both.alias("b").join(hits.alias("h"), _same("b", "h", ["doc", "doc_text", "hash", "template"])).select("b.*", "h.pos", "h.slots")
    return both.checkpoint(), asked.groupBy(*each).agg(F.count_distinct("item_pos").alias("of"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, doc_text, item, n, s) for each distinct row, by id and hash of the text, and item it holds."""
    both, sizes = matched_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, window, similarity)
    place_of = (F.col("pos") - F.col("item_pos")).alias("shift")
    pairs = both.select(*KEY, place_of, F.explode(F.arrays_zip(F.col("item_slots").alias("asked"), F.col("slots").alias("got"))).alias("s"))
    shifts = both.groupBy(*KEY, place_of).agg(F.count("*").alias("windows"))
    votes = pairs.groupBy(*KEY, "shift", "s").agg(F.count("*").alias("n"))
    weighed = votes.alias("v").join(shifts.alias("w"), _same("v", "w", [*KEY, "shift"]))
    # the item laid against the document at its best place decides first, then the count, then the shorter value
    place = F.struct((-F.col("w.windows")).alias("w"), F.col("w.shift").alias("shift"), (-F.col("v.n")).alias("n"), F.length("v.s.got").alias("l"), F.col("v.s.got").alias("got"))
    best = weighed.groupBy(*[F.col(f"v.{k}").alias(k) for k in KEY], F.col("v.s.asked").alias("asked")).agg(F.min(place).alias("b"))
    chosen = best.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("asked", "b.got"))).alias("chosen"))

    def same_value(s):  # a slot at the item's edge may go on in the document
        value = F.element_at("c.chosen", s["asked"])
        left = (F.col("m.edge").bitwiseAND(1) > 0) & (s["asked"] == F.element_at("m.item_slots", 1)) & F.endswith(s["got"], F.concat(F.lit(" "), value))
        right = (F.col("m.edge").bitwiseAND(2) > 0) & (s["asked"] == F.element_at("m.item_slots", -1)) & F.startswith(s["got"], F.concat(value, F.lit(" ")))
        return (value == s["got"]) | left | right

    agree = F.forall(F.arrays_zip(F.col("m.item_slots").alias("asked"), F.col("m.slots").alias("got")), same_value)
    sound = both.alias("m").join(chosen.alias("c"), _same("m", "c", KEY), "left").where((F.size("m.item_slots") == 0) | agree)
    found = sound.groupBy(*[F.col(f"m.{k}").alias(k) for k in KEY]).agg(F.count_distinct("m.item_pos").alias("n"))
    rated = found.alias("f").join(sizes.alias("z"), _same("f", "z", ["item", "item_text"]))
    return rated.select("f.doc", "f.doc_text", "f.item", "f.n", (F.col("f.n") / F.col("z.of")).alias("s")).where(F.col("s") >= similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, item id, n_windows, similarity) for each document and item it holds."""
    rated = contaminated_rows(docs, benchmark, id_col, text_col, **how)
    return rated.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n").cast("long").alias("n_windows"), F.max("s").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose id holds a benchmark item; all columns as they are."""
    bad = contaminated(docs, benchmark, id_col, text_col, **how).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item, whatever other rows have their id."""
    bad = contaminated_rows(docs, benchmark, id_col, text_col, **how).select(F.col("doc").alias("__bad"), F.col("doc_text").alias("__bad_text")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text_col]) == bad["__bad_text"]), "left_anti")

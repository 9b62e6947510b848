"""BPE encoding and decoding by a dynamic programme over prefixes.

Every prefix of a word has exactly one BPE encoding, so one *last token* per prefix
describes them all.  A vocabulary automaton with suffix links (Aho-Corasick) lists the
tokens that end at each position; a token is the last token of the prefix if it is
compatible with the last token of the prefix before it, that is if merging the pair's
symbols gives back exactly that pair.  The back-pointers spell the ids.

Symbols: 256 byte values, and 256 more for a byte that ends its word, because the
vocabulary marks word ends; so a word is one string over 512 symbols and the merges
apply to it as they stand.

Defined cases: null text is the empty text; it has no ids and decodes to the empty
string.  Texts of any length are encoded whole, word by word.  Special-token strings
in the text become their id, as the tokenizer file says.  Decoding joins the
vocabulary strings by one blank, which is what the library does for a file that names
no decoder.  Rows are independent: repeated rows repeat their result, an empty table
gives an empty one, and other columns of the input are not touched.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.batches import bounded_batches

#: Rows whose results one worker holds at a time.
SLICE = 256
#: Words of usual size kept by one Python worker between rows, and twice as many token pairs; more words mean fewer to encode again.
#: The room is counted in bytes, ``WORD_BYTES`` a word of usual size, so long words take the place of several.
CACHE_WORDS, WORD_BYTES = 400_000, 512
#: Unicode White_Space, which the tokenizer's pattern leaves out.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by rule: printable
    Latin-1 bytes stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def word_finders(tokenizer_json: str):
    """(words of any text but such with newer letters, newer letters, words of those texts too, newer capitals' small letters).  The ``regex`` package knows
    letters and numbers that are not assigned yet where Python's tables come from; whether they are to the library its own
    pre-tokenizer says: a letter goes on with the word before it, and a number is none of the signs before it."""
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer_json)
    pieces, normal = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    spans: list[list[str]] = []
    small: dict[int, str] = {}
    for m in regex.finditer(r"(\p{L})|\p{N}", unassigned):
        c = m.group()
        known = len(pieces("a" + c)) == 1 if m.group(1) else len(pieces("!" + c)) == 2
        if normal(c) != c:
            small[ord(c)] = normal(c)
        if known:
            continue
        if spans and ord(c) == ord(spans[-1][1]) + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    odd = "[" + "".join(f"{a}-{b}" for a, b in spans) + "]" if spans else r"(?!)"
    strict = WORDS.replace(r"\p{L}+", rf"(?:(?!{odd})\p{{L}})+").replace(r"|\p{N}|", rf"|(?!{odd})\p{{N}}|")
    strict = strict.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:{odd}|[^{SPACE}\p{{L}}\p{{N}}])+")
    return regex.compile(WORDS).findall, regex.compile(odd).search, regex.compile(strict).findall, small


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Recent(dict):
    """A cache of bounded size: ``cost`` says how much of ``room`` an entry takes.  When it is full it starts anew, and what is
    asked for again is taken over from the one before, so frequent keys stay.  An entry over a thousandth of the room is not kept."""

    def __init__(self, make, room: int, cost):
        super().__init__()
        self.make, self.room, self.cost, self.used, self.before = make, room, cost, 0, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        cost = self.cost(key, got)
        if cost * 1000 > self.room:
            return got
        if self.used + cost > self.room:
            self.before = dict(self)
            self.clear()
            self.used = 0
        self.used += cost
        self[key] = got
        return got


def word_cost(word: str, spelt: tuple[list[int], str]) -> int:
    """Bytes of a kept word, about: texts, list and its numbers, and the table's entry."""
    return 320 + 4 * len(word) + 40 * len(spelt[0]) + len(spelt[1])


class PrefixEncoder:
    """Word -> ids.  Built once per Python worker from the tokenizer file's text."""

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        import ahocorasick
        import regex

        spec = json.loads(tokenizer_json)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"] or ""

        def symbols(token: str) -> str:
            last = bool(end) and token.endswith(end) and token != end
            body = [letters[c] for c in (token[: -len(end)] if last else token)]
            if last:
                body[-1] += 256
            return "".join(map(chr, body))

        vocab = model["vocab"]
        self.strings = {i: t for t, i in vocab.items()}
        self.id_of = {symbols(t): i for t, i in vocab.items()}
        self.word_end = bool(end)
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((symbols(a), symbols(b)), r)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        self.find_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find_words, self.find_newer, self.find_strictly, self.small = word_finders(tokenizer_json)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            if self.merged(s) == [s]:  # a token that its own symbols don't merge to is never emitted
                self.automaton.add_word(s, (len(s), i, i << 32))
        self.automaton.make_automaton()
        # how each token came about: the rank of its merge, -1 for a symbol, and the merge's two sides
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for s, i in self.id_of.items() if len(s) == 1}
        self.pair_rank: dict[int, int] = {}
        for (a, b), r in self.rank.items():
            if a in self.id_of and b in self.id_of and a + b in self.id_of:
                i, j = self.id_of[a], self.id_of[b]
                self.pair_rank[i << 32 | j] = r
                self.made.setdefault(self.id_of[a + b], (r, i, j))
        #: (token id << 32 | token id) -> compatible; word -> (its ids, their strings joined)
        self.pairs = Recent(lambda pair: self.compatible(pair >> 32, pair & 0xFFFFFFFF), max(2 * cache_words, 1000), lambda pair, fits: 1)
        self.words = Recent(self.spelt, WORD_BYTES * cache_words, word_cost)

    def merged(self, text: str) -> list[str]:
        """Plain merging, lowest rank first, leftmost first; for pairs and single tokens only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Merges are undone from the last one back, on the two sides of the border.  If at
        some time the sides could have merged across it, and before the merge that was just undone
        (of equal ranks the left one comes first), the two tokens would not have come about."""
        limit = 1 << 60
        while self.pair_rank.get(a << 32 | b, limit) >= limit:
            (ra, _, a_right), (rb, b_left, _) = self.made[a], self.made[b]
            if ra > rb:
                limit, a = ra, a_right
            elif rb >= 0:
                limit, b = rb + 1, b_left
            else:
                return True
        return False

    def encode_word(self, word: str) -> list[int]:
        symbols = word.encode("utf-8").decode("latin-1")  # one character for each byte
        if self.word_end:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        last: list[tuple[int, int, int] | None] = [None] * len(symbols)
        pairs = self.pairs
        for at, token in self.automaton.iter(symbols):  # of one end, the longest first
            if last[at] is None:
                before = at - token[0]
                if before < 0 or ((prev := last[before]) is not None and pairs[prev[2] | token[1]]):
                    last[at] = token
        ids, at = [], len(symbols) - 1
        while at >= 0:
            n, i, _ = last[at]
            ids.append(i)
            at -= n
        return ids[::-1]

    def spelt(self, word: str) -> tuple[list[int], str]:
        ids = self.encode_word(word)
        return ids, " ".join(map(self.strings.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[list[int], str]]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower-casing is by character: a capital sigma has no word-final form
        low = text.replace("Σ", "σ").lower()
        if is_latin(low):
            return list(map(self.words.__getitem__, self.find_words(low)))
        if self.small:
            low = low.translate(self.small)
        find = self.find_strictly if self.find_newer(low) else self.find_words
        return list(map(self.words.__getitem__, find(low)))

    def encode(self, text: str) -> tuple[list[int], str]:
        if self.find_special is None or not any(s in text for s in self.special):
            pieces = self.pieces(text)
        else:
            pieces = []
            for part in self.find_special.split(text):
                pieces += [([self.special[part]], part)] if part in self.special else self.pieces(part)
        ids: list[int] = []
        for p in pieces:
            ids += p[0]
        return ids, " ".join([p[1] for p in pieces])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=1)
def coder_of(tokenizer_json: str, cache_words: int = CACHE_WORDS) -> PrefixEncoder:
    """The worker's encoder, for all the tasks it runs."""
    return PrefixEncoder(tokenizer_json, cache_words)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     cache_words: int = CACHE_WORDS, reuse: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` and ``decoded``.  The driver reads the
    tokenizer file (its size does not depend on the data) and sends it to the executors as a
    broadcast variable.  Output leaves the worker every ``SLICE`` rows, so a worker holds few results.
    With ``reuse`` a worker keeps its encoder, and the words it knows, from task to task."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = (coder_of if reuse else PrefixEncoder)(spec.value, cache_words)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids, edges, decoded = array("i"), [0], []
                for t in rows.column(1):
                    i, s = coder.encode(t.as_py() or "")
                    ids.extend(i)
                    edges.append(len(ids))
                    decoded.append(s)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.frombuffer(ids, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def digest_columns() -> list[Column]:
    """Token count and SHA-256 digests of the ids and of the decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, *digest_columns())

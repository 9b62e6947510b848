import hashlib
import random

import pytest

from tillsight.llm import bpe
from tillsight.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def coder():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return bpe.PrefixEncoder(f.read())


HARD = ["it's <|endoftext|>A ΣΑΣ İstanbul!!'s 12 3\x1c4\x85x é ﬁ 日本語 🎉👨‍👩‍👧 <|ENDOFTEXT|><|startoftext|>", "", "'", " \n", "x" * 3000,
        "don't we'LL", "é ẛ̣", "a b　c", "'s't're", "ÀÉÎ õü", "1234567890", "\u0000\u0001"]


def test_equals_library(coder, library, texts):
    whole = [t or "" for _, t in texts] + HARD
    for text, want in zip(whole, library.encode_batch(whole, add_special_tokens=False)):
        ids, decoded = coder.encode(text)
        assert ids == want.ids
        assert decoded == coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_letters_of_all_scripts_and_versions(coder, library):
    """Code points that only some Unicode versions know as letters or numbers, and a sample of all."""
    rng = random.Random(6)
    points = [0x558, 0x88F, 0x1C89, 0x1C8A, 0xA7CB, 0x10D40, 0x11DE0, 0x323B0] + [c for c in range(0x250, 0x33480, 97) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b!{chr(c)}1 {chr(c)}" for c in points] + ["".join(rng.choice("ab1! é" + "".join(map(chr, points[:9]))) for _ in range(30)) for _ in range(300)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(text)[0] == want.ids, [hex(ord(c)) for c in text]


def test_long_words_do_not_fill_the_cache(library):
    with open(tokenizer_file(), encoding="utf-8") as f:
        small = bpe.PrefixEncoder(f.read(), cache_words=1000)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("日本語文字列テスト") for _ in range(n))
    texts = [" ".join(word(rng.choice((2, 40, 400))) for _ in range(30)) for _ in range(150)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert small.encode(text)[0] == want.ids
    kept = sum(bpe.word_cost(w, s) for d in (small.words, small.words.before) for w, s in d.items())
    assert 0 < kept <= 2 * 1000 * bpe.WORD_BYTES and max(map(len, small.words)) < 100


def test_last_tokens_equal_plain_merging(coder):
    for word in ("internationalization", "thththth", "aaaaaaaaab", "zqxjkv", "straße"):
        symbols = list(word.encode())
        symbols[-1] += 256
        plain = coder.merged("".join(map(chr, symbols)))
        assert coder.encode_word(word) == [coder.id_of[p] for p in plain]


def test_compatible_equals_merging(coder):
    rng = random.Random(3)
    symbols = {i: s for s, i in coder.id_of.items()}
    sound = [i for i, s in symbols.items() if coder.merged(s) == [s]]
    for _ in range(5000):
        a, b = rng.choice(sound), rng.choice(sound)
        assert coder.compatible(a, b) == (coder.merged(symbols[a] + symbols[b]) == [symbols[a], symbols[b]])


def test_rows(spark, odd, odd_rows, empty, library):
    got = bpe.digests(bpe.encode_documents(odd, tokenizer_file())).collect()
    want = []
    for i, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(empty, tokenizer_file()).count() == 0

import random

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}{'xyz'[i % 3]}" for i in range(30_000))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the small table."""
    return duckdb.execute(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and repeated ids."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "te") for b in ("", "lo", "nu", "sa", "vi")]
    base = " ".join(rng.choice(words) for _ in range(120))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (5, base), (6, "start " + base + " end"), (7, base[:300] + " é 日本語 🎉 " + base[200:]),
        (8, "one"), (9, "two words"), (None, base), (None, None), (10, LONG), (11, LONG + " tail"), (4, "another text under id four"),
        (12, "a a a a " * 40), (13, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with extra columns whose names operators use inside."""
    extra = ["ids", "spans", "fp", "key", "chunk", "id", "node", "score", "component_id", "decoded", "kept", "label", "n", "__text"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

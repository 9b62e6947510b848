import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tillsight.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def checked(found, rows):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found.collect()), key=str)
    want = []
    for i, t in rows:
        spans = brute(t)
        kinds = [k for _, _, k, _ in spans]
        text = ",".join(f"{k}:{a}:{e}" for a, _, k, e in spans)
        want.append((i, *[kinds.count(k) for k in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_against_brute_force(spark, texts):
    rng = random.Random(1)
    bits = ["password", "PassWD", "token", "api_key", "ApiKey", "secret", "=", " : ", "'", '"', "abcdefghijkl", "Zz9+/_.=-", "AKIA", "AKIAABCDEFGHIJKLMN",
            "0123456789abcdef", "deadbeef", " ", "\n", "é", "🎉", "ghp_" + "a1" * 20]
    rows = list(texts) + [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    checked(secrets.digests(secrets.find_secrets(docs)), rows)


def test_odd_rows(odd, odd_rows, empty):
    checked(secrets.digests(secrets.find_secrets(odd)), odd_rows)
    assert secrets.find_secrets(empty).count() == 0


def test_added_spans_and_queries(spark):
    rows = [(1, "x ghp_" + "g" * 36 + " and https://me:pw@host/ -----BEGIN RSA PRIVATE KEY-----")]
    found = secrets.digests(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).first()
    assert [s.split(":")[0] for s in found.spans.split(",")] == ["github", "login", "pem"]
    query = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert query["hex"] is None  # scans every document
    assert ["ken", "oke", "tok"] in query["assign"] and ["aki", "kia"] == query["access"][0]
    # a query is a necessary condition: each match's text meets it
    for text in ("password: abcdefghijklm", "API_KEY='abcdefghijklm", "apikey=abcdefghijklmn"):
        low = text.lower()
        assert any(all(g in low for g in way) for way in query["assign"])


def test_no_python_in_plan(odd):
    plan = secrets.digests(secrets.find_secrets(odd))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text(spark):
    piece = "0123456789abcdef0 "
    rows = [(1, piece * 300 + "é🎉 " + piece * 41), (2, "AKIAABCDEFGHIJKLMN " * 129), (3, "token=abcdefghijklmnop " * 128 + "x"), (4, piece * 127)]
    checked(secrets.digests(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))), rows)

    def seconds(n):
        docs = spark.createDataFrame([(1, piece * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert secrets.find_secrets(docs).select(F.size("spans").alias("n")).first().n == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 5

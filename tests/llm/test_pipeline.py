import hashlib

import pytest

import corpus_pipeline
from tillsight.llm import pii, simhash, toxicity
from tillsight.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, and the whole run."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_file())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontaminate", "pii", "bpe"]

    rows = {r.doc_id: r for r in docs.collect()}
    rejected = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    kept = {i: r for i, r in rows.items() if i not in rejected}
    stage = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == set(kept)

    prints = {i: simhash.fingerprint(r.text) for i, r in kept.items()}
    group = {i: i for i in kept}
    changed = True
    while changed:  # least id that is reachable
        changed = False
        for i in kept:
            for j in kept:
                if group[j] < group[i] and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2:
                    group[i], changed = group[j], True
    kept = {i: r for i, r in kept.items() if group[i] == i}
    stage = corpus_pipeline.simhash_stage(spark, stage.checkpoint(), SMALL).checkpoint()
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == set(kept)

    stage = corpus_pipeline.decontaminate_stage(spark, stage, SMALL).checkpoint()
    plain = lambda t: " ".join((t or "").split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not any(x in plain(r.text) for x in items)}
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == set(kept)

    stage = corpus_pipeline.pii_stage(spark, stage, SMALL).checkpoint()
    of = pii.Anchors()
    clean = {i: pii.redact_text(r.text, of(r.text)) for i, r in kept.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, len(t)) for i, t in clean.items()}

    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in clean.items()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {i: r.ids for i, r in out.items()} == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in out.values())


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0


def test_rows_that_share_an_id_with_a_held_item_stay(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, "x " + item), (None, "clean without an id"), (None, None), (4, item), (4, "clean under id four"), (5, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontaminate_stage(spark, docs, SMALL).collect()
    assert sorted(((str(r.doc_id), str(r.text)) for r in kept)) == [("4", "clean under id four"), ("5", "clean"), ("None", "None"), ("None", "clean without an id")]

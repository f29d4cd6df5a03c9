"""The pipeline against plain versions of its stages, on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline
from data import DOCUMENTS, ENGLISH, GERMAN, hard_documents
from msgtriage.llm import language_id, packing

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        lang, words = (("en", ENGLISH), ("de", GERMAN))[i % 2]
        text = " ".join(f"{w}{rng.integers(0, 9) if k % 3 == 0 else ''}" for k, w in enumerate(rng.choice(words.split(), 60)))
        rows.append([i, text, lang, "s", len(text)])
    for i in range(0, 240, 12):
        rows[i][1] = "BUY!! " * 40  # junk
    for i in range(1, 240, 40):
        rows[i][1] = rows[(i + 200) % 240 | 1][1].upper() if i % 80 == 1 else rows[5][1]
    near = rows[7][1].split()
    near[30] = "changed"
    rows[9][1] = " ".join(near)
    rows[11][1] = None
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([tuple(r) for r in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i % 12 == 0 else 1, 0) for i in range(0, 240, 3)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.schema.names == DOCUMENTS.names
        after[name] = {r["doc_id"] for r in docs.collect()}
        assert after[name] <= before
        before = after[name]
    junk = {i for i in range(0, 240, 12)}
    assert not after["quality_classifier"] & junk and len(after["quality_classifier"]) >= 218
    assert 11 not in after["language_id"] and len(after["language_id"]) >= 0.97 * len(after["quality_classifier"])
    best = {}
    for i in after["language_id"]:
        key = "".join(c.lower() if c.isascii() else c for c in text[i] or "")
        best[key] = max(i, best.get(key, -1))
    assert after["exact_dedup"] == set(best.values())
    assert 7 in after["minhash_near_dedup"] and 9 not in after["minhash_near_dedup"]
    # 1 and 201 differ in the case of letters beyond ASCII, so they are no exact copies.
    assert after["exact_dedup"] - after["minhash_near_dedup"] == {9, 201}


def test_run(spark, corpus):
    folder, _ = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = {p["doc_id"] for p in pieces}
    assert 9 not in docs and 7 in docs and 0 not in docs
    totals = {}
    for p in pieces:
        totals[p["doc_id"]] = totals.get(p["doc_id"], 0) + p["length"]
        assert p["length"] <= packing.CAPACITY
    assert all(totals[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_hard_rows_pass_every_stage(spark, corpus, monkeypatch):
    folder, _ = corpus
    monkeypatch.setattr(language_id.train, "__kwdefaults__", language_id.train.__kwdefaults__ | {"iterations": 5})
    for docs in (hard_documents(spark), spark.createDataFrame([], DOCUMENTS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == DOCUMENTS.names


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "language_id", "exact_dedup", "minhash_near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import ENGLISH, GERMAN, HARD_TEXTS, documents, hard_documents, with_clashes
from msgtriage.llm import language_id as L


def small_network(languages=3, seed=0):
    return L.new_weights(languages, np.random.default_rng(seed))


def windows(*texts):
    return np.concatenate([L.windows_of(t.encode()) for t in texts])


def test_windows_cover_the_text():
    for n in (0, 1, 63, 64, 65, 1000):
        raw = bytes(i % 251 for i in range(n))
        found = L.windows_of(raw)
        assert bytes(found[found != L.PAD].astype(np.uint8)) == raw and found.shape[1] == L.STEPS


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    w, x, y = small_network(), windows("short", "ein längerer Text, der zwei Fenster füllt und noch etwas mehr"), np.array([0, 2])
    _, g = L.gradients(w, x, y)
    for k in w:
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        if k == "input":
            i = (i[0], int(x[0][1]), i[2])
        up, down = ({a: b.copy() for a, b in w.items()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        slope = (L.gradients(up, x, y)[0] - L.gradients(down, x, y)[0]) / 2e-2
        assert slope == pytest.approx(float(g[k][i]), abs=2e-4)


def test_scoring_layout_equals_the_network():
    w, x = small_network(), windows(ENGLISH, GERMAN, "")
    states, _, real, _ = L.forward(w, x)
    want = (L.position_probabilities(w, states) * real[:, 0, :, None]).sum(axis=0)
    assert np.allclose(L.pooled_probabilities(w, x), want, atol=1e-5)


def test_padding_does_not_matter():
    model = L.LanguageModel(["a", "b", "c"], small_network())
    alone = model.document_probabilities([b"abc"])
    beside = model.document_probabilities([ENGLISH.encode() * 3, b"abc", b""])
    assert np.allclose(alone[0], beside[1], atol=1e-6)
    assert np.allclose(alone.sum(), 1, atol=1e-5)


@pytest.fixture(scope="module")
def corpus(spark):
    english, german = ENGLISH.split(), GERMAN.split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(english if i % 2 else german, 30)), "en" if i % 2 else "de") for i in range(160)]
    return documents(spark, rows)


def test_held_out_accuracy(spark, corpus, monkeypatch):
    monkeypatch.setattr(L, "ITERATIONS", 60)
    monkeypatch.setattr(L.train, "__kwdefaults__", L.train.__kwdefaults__ | {"iterations": 60})
    model = L.LanguageModel.fit(corpus.where("doc_id % 4 != 2"))
    assert model.languages == ["de", "en"]
    rows = corpus.where("doc_id % 4 = 2").select("lang", model.column(F.col("text")).alias("p")).collect()
    assert np.mean([r["p"]["lang_pred"] == r["lang"] for r in rows]) > 0.95
    hard = with_clashes(hard_documents(spark), "score", "lang_pred", "id").withColumn("p", model.column(F.col("text")))
    for r in hard.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] == "und") == (not letters)
        assert 0 <= r["p"]["score"] <= 1


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None, "en"), (2, "text", None), (3, "123", "en")]):
        model = L.LanguageModel.fit(documents(spark, rows))
        assert model.predict(["some text", None]) == (["und", "und"], [0.0, 0.0])


def test_one_language(spark):
    model = L.LanguageModel(["en"], small_network(1))
    langs, scores = model.predict(HARD_TEXTS)
    assert set(langs) == {"en", "und"} and max(scores) == pytest.approx(1)


def test_every_language_is_learnt(spark, monkeypatch):
    seen = {}

    def train(windows, labels, languages, **more):
        seen.update(labels=set(labels.tolist()), more=more)
        return L.new_weights(languages, np.random.default_rng(0))

    monkeypatch.setattr(L, "train", train)
    rows = [(i, f"{ENGLISH} {i}", f"lang{i % 70}" if i < 700 else f"rare{i}") for i in range(705)]
    model = L.LanguageModel.fit(documents(spark, rows))
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 75
    assert seen == {"labels": set(range(75)), "more": {"iterations": 2 * L.ITERATIONS}}
    texts = [ENGLISH.encode() * 40, GERMAN.encode()] * 3
    want = model.document_probabilities(texts)
    monkeypatch.setattr(L.LanguageModel, "CHUNK", 7)
    assert np.allclose(model.document_probabilities(texts), want, atol=1e-6)
    monkeypatch.setattr(L, "SAMPLE_DOCS", 1)  # less than one a language
    L.LanguageModel.fit(documents(spark, rows))
    assert seen["labels"] == set(range(75))
    monkeypatch.setattr(L, "MAX_LANGS", 74)
    with pytest.raises(ValueError, match="74"):
        L.LanguageModel.fit(documents(spark, rows))

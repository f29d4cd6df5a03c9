import math
from collections import Counter

import numpy as np
import pytest

from data import ENGLISH, GERMAN, HARD_TEXTS, documents, hard_documents, with_clashes
from msgtriage.llm import lm_scoring as M


def tokens(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        raw = raw.replace(space, " ")
    return [w for w in raw.split(" ") if w] + [None]


def test_words_are_those_of_the_definition():
    for text in HARD_TEXTS:
        if len(text or "") < 2000:
            assert [w.decode() if w else None for w in M.words((text or "").encode())] == tokens(text)
    assert M.words(b"x" * 40)[0] == M.words(b"X" * 40)[0] != M.words(b"x" * 41)[0]


def test_contexts():
    near, far, target = M.contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([3, 1, 2]), 9)
    assert near.tolist() == [9, 1, 2, 9, 9, 5] and far.tolist() == [9, 9, 1, 9, 9, 9]


def test_probabilities_are_normalised():
    share = np.array([0.5, 0.2, 0.2, 0.1])
    model = M.LogBilinear(share)
    rng = np.random.default_rng(0)
    model.w = {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in model.w.items()}
    for near, far in ((0, 1), (4, 4), (2, 4)):
        each = model.log_probabilities(np.full(4, near), np.full(4, far), np.arange(4), model.normalisers())
        assert np.exp(each).sum() == pytest.approx(1, abs=1e-5)


def test_noise_contrastive_gradient(monkeypatch):
    monkeypatch.setattr(M, "RATE", 1.0)
    share = np.array([0.4, 0.3, 0.2, 0.1])
    near, far, target = np.array([0, 1, 4]), np.array([4, 0, 4]), np.array([2, 3, 0])
    weight = np.array([1, 2, 1])

    def loss(model, noise):
        r = model.predicted(near, far)
        delta = lambda t: np.einsum("ij,j->i", r, model.w["target"][t]) + model.w["bias"][t] - np.log(M.NOISE * share[t])
        real = np.array([delta(t)[i] for i, t in enumerate(target)])
        total = np.logaddexp(0, -real) + sum(np.logaddexp(0, delta(t)) for t in noise)
        return (total * weight).sum() / weight.sum()

    model = M.LogBilinear(share)
    start = {k: v.copy() for k, v in model.w.items()}
    noise = np.random.default_rng(6).choice(4, size=M.NOISE, p=share)
    model.memory = {k: np.full(v.shape, 1.0) for k, v in model.w.items()}
    model.learn(near, far, target, weight, np.random.default_rng(6))
    for k, at in (("target", (2, 3)), ("context", (4, 1)), ("near", (1, 2)), ("far", (0, 0)), ("bias", (3,))):
        moved = float(start[k][at] - model.w[k][at])  # g / sqrt(1 + g^2)
        slope = []
        for sign in (1, -1):
            other = M.LogBilinear(share, {x: y.astype(float).copy() for x, y in start.items()})
            other.w[k][at] += sign * 1e-4
            slope.append(loss(other, noise))
        g = (slope[0] - slope[1]) / 2e-4
        assert moved == pytest.approx(g / math.sqrt(1 + g * g), abs=2e-4)


@pytest.mark.parametrize("frequent", [200_000, 5])
def test_base_score_by_hand(spark, frequent):
    df = hard_documents(spark)
    train = "doc_id % 3 != 0"
    from pyspark.sql import functions as F

    model = M.LanguageModel.fit(df, train=F.expr(train), frequent=frequent, classes=4)
    got = model.score(with_clashes(df, "tag", "word", "score", "rest")).collect()
    rows = df.collect()
    count = Counter(t for r in rows if r["doc_id"] is not None and r["doc_id"] % 3 != 0 for t in tokens(r["text"]))
    total, size = sum(count.values()), len(count)
    want = {}
    for r in rows:
        found = tokens(r["text"])
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (size + 1))) for t in found)
        want.setdefault(r["doc_id"], []).append((len(found), sum(count[t] > 0 for t in found), total, base))
    assert len(got) == len(rows)
    for r in got:
        assert any(
            (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3])
            for w in want[r["doc_id"]])
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_learns_from_context(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice((ENGLISH if i % 2 else GERMAN).split(), 80))) for i in range(300)]
    df = documents(spark, rows)
    from pyspark.sql import functions as F

    model = M.LanguageModel.fit(df, train=F.expr("doc_id % 10 != 0"), classes=40)
    held = model.score(df.where("doc_id % 10 = 0")).collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.95


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    assert M.LanguageModel.fit(documents(spark, [])).score(documents(spark, [])).collect() == []
    row = M.LanguageModel.fit(documents(spark, [(1, "a")]), train=F.lit(False)).score(documents(spark, [(1, "a")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (2, 0, 0)
    assert row["base_score"] == pytest.approx(0) == row["score"]

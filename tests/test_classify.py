import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgtriage.operators import classify, labeling
from msgtriage.operators.classify import Constant, IntentModel, IntentSettings, LinearWeights
from msgtriage.operators.tfidf import TfidfConfig
from msgtriage.packs import support

TRAIN = [
    ("battery drains fast", "power"), ("battery dies quickly", "power"), ("charge the battery", "power"),
    ("battery battery swollen", "power"), ("keyboard lag after update", "software"),
    ("update froze keyboard", "software"), ("refund my charge please", "billing"),
    ("charged twice refund", "billing"),
]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "customer_text string, intent string")


def minimise(x, y, weights, c, steps=40_000, rate=0.5):
    """Gradient descent on the weighted, L2-penalised multinomial loss; plain numpy."""
    n, d = x.shape
    k = int(y.max()) + 1
    w, b, onehot = np.zeros((d, k)), np.zeros(k), np.eye(k)[y]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) * weights[:, None]
        w -= rate * (x.T @ g + w / c) / n
        b -= rate * g.sum(axis=0) / n
    z = x @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_fit_minimises_the_balanced_objective(train):
    model = IntentModel.fit(train, IntentSettings(TfidfConfig(1, 2, 100, sublinear=True), 2.5, 1500))
    assert model.labels == ["billing", "power", "software"]
    predicted = {r["customer_text"]: r for r in model.predict(train.select("customer_text")).collect()}
    texts = [t for t, _ in TRAIN]
    rows = model.tfidf.transform(train, "customer_text").collect()
    x = np.zeros((len(rows), len(model.tfidf.terms)))
    for i, r in enumerate(rows):
        x[i, r["tfidf"]["indices"]] = r["tfidf"]["values"]
    order = [r["customer_text"] for r in rows]
    labels = [dict(TRAIN)[t] for t in order]
    y = np.array([model.labels.index(l) for l in labels])
    weights = np.array([len(y) / (3 * labels.count(l)) for l in labels])
    p = minimise(x, y, weights, 2.5)
    for i, t in enumerate(order):
        assert predicted[t]["intent"] == model.labels[int(p[i].argmax())]
        assert predicted[t]["confidence"] == pytest.approx(p[i].max(), abs=2e-3)
    assert set(order) == set(texts)


def test_model_survives_saving(spark, train, tmp_path):
    model = IntentModel.fit(train, classify.SIMPLE)
    model.save(spark, str(tmp_path / "m"))
    again = IntentModel.load(spark, str(tmp_path / "m"))
    df = train.select("customer_text")
    assert sorted(map(tuple, again.predict(df).collect())) == sorted(map(tuple, model.predict(df).collect()))


def test_unknown_and_null_texts_get_an_answer(spark, train):
    model = IntentModel.fit(train, classify.SIMPLE)
    df = spark.createDataFrame([("zzz",), (None,)], "customer_text string")
    assert all(0 < r["confidence"] < 1 for r in model.predict(df).collect())


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([("aa", "x")], "customer_text string, intent string")
    with pytest.raises(ValueError, match="classes"):
        IntentModel.fit(df, classify.SIMPLE)


def test_balanced_weights(train):
    got = {r["intent"]: r["weight"] for r in classify.class_weights(train).collect()}
    assert got == pytest.approx({"power": 8 / 12, "software": 8 / 6, "billing": 8 / 6})


def test_majority_ties_in_label_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "intent string")
    assert tuple(classify.majority_class(df).first()) == ("a", 1)


def test_linear_weights(spark):
    model = LinearWeights({"x": {"aa": 1.0, "bb": 0.5}, "y": {"aa": 0.2}}, {"y": 0.1})
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "aab"), (3, None)], "id int, customer_text string")
    got = {(r["id"], r["label"]): r for r in model.probabilities(df, "customer_text", "id").collect()}
    assert got[1, "x"]["score"] == pytest.approx(2.5) and got[1, "y"]["score"] == pytest.approx(0.5)
    assert got[1, "x"]["probability"] == pytest.approx(math.exp(2.5) / (math.exp(2.5) + math.exp(0.5)))
    best = {r["id"]: r["intent"] for r in model.predict(df).collect()}
    assert best == {1: "x", 2: "y", 3: "y"}


def test_damping(spark):
    df = spark.createDataFrame(
        [(support.ACCOUNT, "help"), (support.ACCOUNT, "my PASSWORD"), (support.BILLING, "help")],
        "intent string, t string")
    damped = classify.damp_confidence(
        F.col("intent"), F.lit(0.8), F.col("t"), support.ACCOUNT, support.PACK.damped_terms)
    assert [round(r[0], 6) for r in df.select(damped).collect()] == [0.6, 0.8, 0.8]


def test_constant(spark):
    df = spark.createDataFrame([("t",)], "customer_text string")
    assert tuple(Constant("z").predict(df).first()) == ("t", "z", 1.0)


def test_training_cap_counts_seeds(spark):
    seeds = spark.createDataFrame([(1, "seed", "power"), (2, "seed", "power")], "id long, customer_text string, intent string")
    rows = [(i, f"my battery is empty again {i}") for i in range(10, 30)] + [(5, "short battery")]
    corpus = spark.createDataFrame(rows, "id long, customer_text string")
    built = labeling.training_set(seeds, corpus, support.LEXICON, cap=6)
    assert sorted((r["priority"], r["id"]) for r in built.collect()) == [(0, 1), (0, 2), (1, 10), (1, 11), (1, 12), (1, 13)]
    assert labeling.training_set(seeds, corpus, support.LEXICON, cap=2).count() == 2


def test_coefficients_are_those_of_the_model(spark, train):
    model = IntentModel.fit(train, IntentSettings(TfidfConfig(1, 2, 50), 1.0, 100))
    matrix = model.regression.coefficientMatrix.toArray()
    want = {(label, term): matrix[i][j] for i, label in enumerate(model.labels) for j, term in enumerate(model.tfidf.terms)}
    got = {(r["intent"], r["term"]): r["coefficient"] for r in model.coefficients(spark).collect()}
    assert got == pytest.approx(want)


def test_certificate_tells_a_fitted_model(spark):
    """The gradient vanishes for the fit, and does not for a fit that was stopped."""
    from dataclasses import replace

    from msgtriage.operators import classify

    words = {"a": ["red", "rose", "ruby"], "b": ["blue", "sky", "sea"], "c": ["green", "leaf", "grass"]}
    rows = [(i, " ".join(w[(i + j) % 3] for j in range(1 + i % 4)) + f" common{i % 5}", label)
            for label, w in words.items() for i in range(20)]
    df = spark.createDataFrame(rows, "id long, customer_text string, intent string")
    settings = replace(classify.PRODUCTION, features=replace(classify.PRODUCTION.features, max_features=40))
    done = {r["intent"]: r for r in classify.IntentModel.fit(df, settings).certificate(df).collect()}
    assert set(done) == set(words) and all(r["converged"] and r["n"] == 20 for r in done.values())
    stopped = classify.IntentModel.fit(df, replace(settings, max_iter=1)).certificate(df).collect()
    assert not any(r["converged"] for r in stopped)


def test_a_larger_training_set_is_fitted_on_all_cores(train, monkeypatch):
    """Above the rows of one part, there is a part for each core; the model stays the same."""
    settings, parts = IntentSettings(TfidfConfig(1, 1, 50), 1.0, 200), []
    alone = IntentModel.fit(train, settings)
    stored = classify.materialize
    monkeypatch.setattr(
        classify, "materialize", lambda df, name: (name == "features" and parts.append(df.rdd.getNumPartitions())) or stored(df, name))
    monkeypatch.setattr(classify, "ROWS_PER_PART", train.count() - 1)
    monkeypatch.setattr(classify, "ROWS_PER_CORE", 1)
    spread = IntentModel.fit(train, settings)
    assert parts == [min(train.count(), train.sparkSession.sparkContext.defaultParallelism)] and parts[0] > 2
    one, other = ({(r["intent"], r["term"]): r["coefficient"] for r in m.coefficients(train.sparkSession).collect()}
                  for m in (alone, spread))
    assert other == pytest.approx(one, abs=1e-2)

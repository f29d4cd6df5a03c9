import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import ENGLISH, HARD_TEXTS, documents, hard_documents, with_clashes
from msgtriage.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=200):
    rng = np.random.default_rng(5)
    words = ENGLISH.split()
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 25))
        rows.append((i, text if i % 5 else text.upper().replace(" ", "!! ") + "!!"))
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, n, 2)], LABELS)
    return documents(spark, rows), labels


def test_features_are_the_same_everywhere():
    words = Q.Features(1 << 10)
    alone = [words.of([t]) for t in ("a b  c", "", "x, y!!", "no no no")]
    together, owner = Q.Features(1 << 10).of(["a b  c", "", "x, y!!", "no no no"])
    for i, (buckets, _) in enumerate(alone):
        assert sorted(buckets) == sorted(together[owner == i])
    assert len(alone[0][0]) == 5 and len(alone[1][0]) == 0 and len(alone[2][0]) == 7
    # All words with themselves: one bucket.
    assert words.of(["go go"])[0][-1] == words.of(["no no"])[0][-1]


def test_runs_by_plain_rules():
    """Words are runs of ASCII word characters and of what is beyond ASCII; the rest but white space is punctuation."""
    import re

    from msgtriage.llm import runs

    texts = [t or "" for t in HARD_TEXTS] + [ENGLISH]
    seen = {}
    for punctuation, pattern in ((True, r"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff \t\n\x0b\x0c\r]+"), (False, r"[0-9A-Za-z_\x80-\xff]+")):
        codes, owner = runs.hashed_runs(texts, punctuation)
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern.encode("latin-1"), t.lower().encode())]
        assert owner.tolist() == [i for i, _ in want]
        for code, (_, w) in zip(codes.tolist(), want):
            assert seen.setdefault(w, code) == code
    assert len(set(seen.values())) == len(seen)


def test_junk_goes_and_good_stays(spark):
    docs, labels = corpus(spark)
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(200) if i % 5}


def test_weight_by_hand(spark):
    docs = documents(spark, [(1, "a b"), (2, "c"), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (1, 0, 0)], LABELS)
    model = Q.QualityModel.fit(docs, labels, buckets=1 << 10, smoothing=1.0)
    # Features: a, b and ab (good), c (not good); four in all, three of the target.
    good, bad = (1 + 1) / (0.75 + 1), 1 / (0.75 + 1)
    scale = (3 * good + bad) / 4
    good, bad = math.log(good / scale), math.log(bad / scale)
    got = {r[0]: r[1] for r in docs.select("doc_id", model.column(F.col("text"))).collect()}
    assert got == pytest.approx({1: 3 * good, 2: bad, 3: 0.0})


@pytest.mark.parametrize("k", [0, 1, 37, 199, 200, 500])
def test_gumbel_top_k(spark, k):
    docs, labels = corpus(spark)
    drawn = Q.resample(docs, Q.QualityModel.fit(docs, labels), k=k).collect()
    want = sorted(drawn, key=lambda r: (-round(r["perturbed"], 6), r["doc_id"]))[:k]
    assert {r["doc_id"] for r in drawn if r["kept"]} == {r["doc_id"] for r in want}


def test_noise_is_gumbel(spark):
    docs = documents(spark, [(i, "same") for i in range(4000)])
    model = Q.QualityModel(np.zeros(Q.BUCKETS))
    noise = [r["perturbed"] for r in Q.resample(docs, model, k=4000).collect()]
    assert np.mean(noise) == pytest.approx(0.5772, abs=0.08) and np.var(noise) == pytest.approx(math.pi**2 / 6, rel=0.12)
    # An equal share of equal documents, whichever they are.
    kept = [r["doc_id"] for r in Q.resample(docs, model, k=1000).collect() if r["kept"]]
    assert len(kept) == 1000 and 400 < sum(i < 2000 for i in kept) < 600


def test_ties_by_id(spark):
    places = spark.createDataFrame([(i, 5) for i in range(10)], "id long, place long")
    assert [i for i in range(10) if places.select(Q._nth_id(places, 4)(F.lit(i))).first()[0]] == [0, 1, 2, 3]


def test_hard_rows_and_no_labels(spark):
    docs = with_clashes(hard_documents(spark), "kept", "log_weight", "place", "id")
    none = spark.createDataFrame([], LABELS)
    out = Q.keep_good(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()
    some = spark.createDataFrame([(100, 1, 0), (None, None, None)], LABELS)
    assert Q.keep_good(docs, some).columns == docs.columns
    assert Q.keep_good(documents(spark, []), some).collect() == []


def test_buckets_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        Q.Features(1000)

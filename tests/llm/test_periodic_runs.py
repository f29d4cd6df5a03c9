"""Periodic runs against a word-by-word search."""

import hashlib
import random
from zlib import crc32

import pytest
from data import HARD_TEXTS, documents, hard_documents, with_clashes
from pyspark.sql import functions as F

from msgtriage.llm import periodic_runs, queries


def brute_runs(words):
    """Every lag from every place, and periods told by trying all shorter ones."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def random_words(rng):
    kinds = rng.choice([1, 2, 3, 5, 9])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(70))]
    if len(words) > 3 and rng.random() < 0.7:
        a = rng.randrange(len(words))
        p = rng.randrange(1, (len(words) - a) // 3 + 2)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_random_texts():
    rng = random.Random(11)
    texts = [" ".join(random_words(rng)) for _ in range(3000)]
    for text, (runs, kept) in zip(texts, periodic_runs.analyse(texts)):
        words = text.encode().split()
        assert runs == brute_runs(words), text
        assert kept == brute_collapsed(words, runs)


@pytest.mark.parametrize("text, runs", [
    ("", []), ("x x x x x", []), ("x x x x x x", [(0, 6, 1)]), ("a b a b a b a", []), ("a b a b a b a b", [(0, 8, 2)]),
    ("q a b a b a b a b r x x x x x x", [(1, 8, 2), (10, 6, 1)]),
    ("x x x x x x x x", [(0, 8, 1)]),
    # Two runs that overlap.
    ("a a a a a a b a a a a a a b a a a a a a b a a a a a a b", [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
])
def test_small(text, runs):
    assert next(periodic_runs.analyse([text]))[0] == runs


def test_segments_split_until_stable():
    import numpy as np

    # c splits first; only then is b too rare on its side.
    words = np.array([0, 1, 0, 1, 0, 1, 0, 2, 0, 1, 0, 0, 0, 0, 0, 0])
    starts, ends = periodic_runs.surviving_segments(words, np.zeros(len(words), int))
    assert list(zip(starts.tolist(), ends.tolist())) == [(10, 16)]


def test_long_texts_are_scanned_whole():
    long_period = [f"w{i}" for i in range(3000)]
    texts = ["x " * 60_000, " ".join(long_period * 5), " ".join([*long_period, *["a b"] * 4])]
    found = [runs for runs, _ in periodic_runs.analyse(texts)]
    assert found == [[(0, 60_000, 1)], [(0, 15_000, 3000)], [(3000, 8, 2)]]


def test_column(spark):
    df = with_clashes(hard_documents(spark), "runs", "collapsed", "found")
    rows = df.select("doc_id", "text", periodic_runs.periodic_runs(F.col("text")).alias("r")).collect()
    assert len(rows) == df.count()
    for row in rows:
        words = (row["text"] or "").encode().split()
        runs = brute_runs(words) if len(words) < 500 else None
        if runs is not None:
            assert [tuple(r) for r in row["r"]["runs"]] == runs
            assert row["r"]["collapsed"] == brute_collapsed(words, runs)
    assert any(r["text"] == HARD_TEXTS[19] and r["r"]["collapsed"] == "word" for r in rows)


def test_empty_table(spark):
    df = hard_documents(spark).where("false")
    assert df.select(periodic_runs.periodic_runs(F.col("text"))).count() == 0


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(brute_collapsed(words, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = {i: " ".join(random_words(rng)) for i in range(400)} | {1000: None, 1001: "", 1002: "  a b\x1c " * 9}
    # Enough documents whose words the query is to repeat.
    planted = [i for i in range(2000, 9000) if crc32(str(i).encode()) % 10 == 0][:150]
    texts |= {i: " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(80))) for i in planted} | {planted[0]: None}
    documents(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(expected_row(i, t) for i, t in texts.items())

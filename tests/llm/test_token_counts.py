import math

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from data import ENGLISH, HARD_TEXTS, documents, hard_documents
from msgtriage.llm import token_counts as C

VOCABULARY = C.Vocabulary.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))


def brute_force(pre_token, scores):
    """Best segmentation by trying the last piece of every prefix, without sharing."""
    best = [(0.0, 0)]
    for end in range(1, len(pre_token) + 1):
        width = len(pre_token[end - 1].encode())
        options = [(best[end - 1][0] + C.BYTE_SCORE * width, best[end - 1][1] + width)]
        options += [(best[start][0] + scores[pre_token[start:end]], best[start][1] + 1)
                    for start in range(end) if pre_token[start:end] in scores]
        top = max(value for value, _ in options)
        best.append((top, min(n for value, n in options if value == top)))
    return best[-1][1]


def test_all_segmentations():
    scores = {"a": -2.0, "b": -2.0, "ab": -3.0, "ba": -3.0, "aba": -5.0, "▁": -1.0, "▁a": -2.5}
    trie = C.Trie(scores)

    def every(word):
        if not word:
            yield 0.0, 0
        for size in range(1, len(word) + 1):
            piece = word[:size]
            step = scores.get(piece, C.BYTE_SCORE * len(piece.encode()) if size == 1 else None)
            if step is not None:
                for value, n in every(word[size:]):
                    yield value + step, n + (1 if piece in scores else len(piece.encode()))

    for word in ("▁a", "▁ab", "▁abab", "▁bababa", "▁aabbc", "é"):
        top = max(v for v, _ in every(word))
        assert trie.count(word) == min(n for v, n in every(word) if math.isclose(v, top))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="thequickér日", min_size=1, max_size=12), max_size=8))
def test_shared_prefixes(words):
    trie = C.Trie(VOCABULARY.scores)
    for word in words:
        assert trie.count(C.MARK + word) == brute_force(C.MARK + word, VOCABULARY.scores)
    # A node for every distinct prefix, and the root.
    assert len(trie.best) == 1 + len({(C.MARK + w)[:i] for w in words for i in range(1, len(w) + 2)})


def test_trie_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "MAX_NODES", 20)
    trie = C.Trie(VOCABULARY.scores)
    for word in ENGLISH.split() * 2:
        assert trie.count(C.MARK + word) == brute_force(C.MARK + word, VOCABULARY.scores)
    assert len(trie.best) < 40


def test_column(spark):
    count = C.counter(VOCABULARY)
    for r in hard_documents(spark).select("text", count(F.col("text")).alias("c")).collect():
        if len(r["text"] or "") < 2000:
            words = [C.MARK + w for w in (r["text"] or "").split()]
            assert tuple(r["c"]) == (len(words), sum(brute_force(w, VOCABULARY.scores) for w in words))
    assert documents(spark, []).select(count(F.col("text"))).collect() == []


def test_no_pieces():
    assert C.Trie({}).count("é") == 2
    assert [C.Trie({}).count(t) for t in HARD_TEXTS if t == ""] == [0]


def test_vocabulary_is_a_distribution():
    assert sum(math.exp(s) for s in VOCABULARY.scores.values()) == pytest.approx(1, abs=1e-3)

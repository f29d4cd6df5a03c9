import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from data import ENGLISH, GERMAN, HARD_TEXTS, documents, hard_documents
from msgtriage.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TOKENS = packing.Tokens(open(PATH, encoding="utf-8").read())


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*filter(None, HARD_TEXTS), ENGLISH, GERMAN])
def test_ids_of_the_library(text):
    assert ids_of(TOKENS.encode(text)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    assert ids_of(TOKENS.encode(text)) == library(text)


def check(pieces, texts, capacity):
    """Every id in exactly one piece, sequences gapless; returns the sequences' lengths."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["length"] == len(bytes(p["ids"])) // 4 > 0
    for doc, group in texts.items():
        want = sorted(tuple(library(t) + [packing.END_ID]) for t in group)
        got = sorted(by_doc[doc], key=lambda p: p["start"])
        if len(group) == 1:
            ids = []
            for p in got:
                assert p["start"] == len(ids) and p["doc_tokens"] == len(want[0])
                ids += ids_of(bytes(p["ids"]))
            assert tuple(ids) == want[0]
        else:
            assert sum(p["length"] for p in got) == sum(map(len, want))
    assert set(by_doc) == set(texts)
    lengths = []
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        lengths.append(at)
    return lengths


@pytest.mark.parametrize("capacity, windows, partitions", [(4096, 32, 3), (64, 4, 5), (7, 1, 2), (1, 1, 1)])
def test_pieces(spark, capacity, windows, partitions):
    df = hard_documents(spark).repartition(partitions)
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"])
    pieces = packing.pack(df, TOKENS, capacity=capacity, windows=windows).collect()
    lengths = check(pieces, texts, capacity)
    # No padding: every sequence is full, or its length is a power of two, and those sizes differ.
    odd = [n for n in lengths if n != capacity]
    assert all(n & (n - 1) == 0 for n in odd) and len(odd) == len(set(odd))


def test_rounds_of_remainders(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = documents(spark, [(i, f"{ENGLISH} {i}") for i in range(60)]).repartition(9)
    pieces = packing.pack(df, TOKENS, capacity=100, windows=3).collect()
    lengths = check(pieces, {i: [f"{ENGLISH} {i}"] for i in range(60)}, 100)
    assert sum(n != 100 for n in lengths) <= 7


def test_empty_table_and_query_digest(spark):
    assert packing.pack(documents(spark, []), TOKENS).collect() == []
    piece = packing.pack(documents(spark, [(1, None)]), TOKENS).first()
    assert zlib.crc32(bytes(piece["ids"])) == zlib.crc32(b"\x02\x00\x00\x00")


def test_best_fit_and_the_fullest():
    packer = packing.Packer(10, 2, 0)
    ids = lambda n: np.arange(n, dtype="<u4").tobytes()
    assert [*packer.add(1, 0, ids(6), 6), *packer.add(2, 0, ids(8), 8)] == []
    assert [*packer.add(3, 0, ids(2), 2)][-1][:3] == (3, 0, 2)  # the window of 8, the better fit
    assert [*packer.add(4, 0, ids(9), 9)] == []  # a new window
    cut = [*packer.add(5, 0, ids(7), 7)]  # fits none: the fullest (9) takes one id
    assert [p[:3] for p in cut] == [(4, 0, 9), (5, 0, 1)]
    with pytest.raises(StopIteration):
        next(packer.add(6, 0, b"", 0))

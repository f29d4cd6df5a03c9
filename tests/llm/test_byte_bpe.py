import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from data import ENGLISH, GERMAN, HARD_TEXTS, documents, hard_documents
from msgtriage.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("text", [*filter(None, HARD_TEXTS), ENGLISH, GERMAN, "ab" * 4000, " " * 300])
def test_ids_of_the_library_and_round_trip(text):
    raw = CODEC.encode(text)
    assert ids_of(raw) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(raw) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert ids_of(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)


def test_memo_is_bounded(monkeypatch):
    codec = byte_bpe.Codec(CODEC.tokens, CODEC.pattern, CODEC.model)
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 3)
    text = " ".join(ENGLISH.split() * 3)
    assert ids_of(codec.encode(text)) == LIBRARY.encode_ordinary(text)
    assert len(codec.memo) <= 3


def test_column(spark):
    df = hard_documents(spark)
    encode, decode = byte_bpe.encoder(CODEC), byte_bpe.decoder(CODEC)
    rows = df.select("text", encode(F.col("text")).alias("ids")).withColumn("back", decode(F.col("ids"))).collect()
    assert len(rows) == df.count()
    for r in rows:
        text = r["text"] or ""
        assert ids_of(bytes(r["ids"])) == LIBRARY.encode_ordinary(text)
        assert hashlib.sha256(bytes(r["back"])).digest() == hashlib.sha256(text.encode()).digest()
    assert documents(spark, []).select(encode(F.col("text"))).collect() == []


def test_ranks_must_be_gapless(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))

"""Sentencepiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from data import ENGLISH, GERMAN, HARD_TEXTS, documents, hard_documents
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from msgtriage.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
END = 2


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.Model.read(PATH)


@pytest.fixture(scope="module")
def made(model):
    return piece_bpe.Encoder(model)


def ids_of(made, text):
    return np.frombuffer(made.encode(text), "<i4").tolist()


MORE = ["▁", "a▁b", "</s><s><unk>", "<0x0A>", "\n\n\n", "a\n b", " a", "a" * 3000, "ab" * 700,
        "  a   b    c" + " " * 15 + "d" + " " * 33, "日本語 テキスト" * 40, "\U0010ffff�"]


@pytest.mark.parametrize("text", [t for t in HARD_TEXTS if t is not None] + MORE + [ENGLISH, GERMAN])
def test_equals_library(made, model, library, text):
    expected = [*library.encode(text), END]
    assert ids_of(made, text) == expected
    assert piece_bpe.Decoder(model).decode(expected) == library.decode(expected)


def test_random_texts(made, library):
    rng = random.Random(13)
    for alphabet in ("abetioTHE .,'▁\n0éß日Я", "ab ", "aehnrst", " \t"):
        for _ in range(2000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert ids_of(made, text) == [*library.encode(text), END], repr(text)


def test_runs_of_spaces(made, library):
    for n in range(1, 140):
        for text in (" " * n, " " * n + "word", "word" + " " * n + "word"):
            assert ids_of(made, text) == [*library.encode(text), END]


def test_backtracking_agrees_with_merging(made, model):
    rng = random.Random(14)
    pieces = [p for p in model.ids if piece_bpe.SPACE not in p and len(p) > 2]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
        assert made.tokens(text) == model.merged(text)


def test_backtracking_takes_back():
    """A vocabulary in which the longest match is not the right one, and one in which all but one way fail."""
    made = piece_bpe.Encoder(small_model(["ab", "bc", "abc", "cd"], "abcd"))
    for text in ("abcd", "abcabcd", "bcd", "abccd", "abab", "dcba"):
        assert made.tokens(text) == made.model.merged(text)
    assert made.tokens("abcd") == ["abc", "d"]
    made = piece_bpe.Encoder(small_model(["cd", "bc", "ab", "abc"], "abcd"))
    assert made.tokens("abcd") == made.model.merged("abcd") == ["ab", "cd"]


def small_model(merges, characters):
    out = proto.ModelProto()
    kinds = proto.ModelProto.SentencePiece
    out.trainer_spec.model_type, out.trainer_spec.byte_fallback = proto.TrainerSpec.BPE, True
    out.normalizer_spec.name, out.normalizer_spec.escape_whitespaces = "identity", True
    out.normalizer_spec.remove_extra_whitespaces = False
    out.pieces.add(piece="<unk>", type=kinds.UNKNOWN)
    out.pieces.add(piece="</s>", type=kinds.CONTROL)
    for i, piece in enumerate([*merges, *characters]):
        out.pieces.add(piece=piece, score=-float(i), type=kinds.NORMAL)
    return piece_bpe.Model(out.SerializeToString())


def test_long_stretches_are_merged_by_a_queue(model, library):
    rng = random.Random(15)
    for _ in range(200):
        text = "".join(rng.choice("abeth ▁") for _ in range(60))
        assert model._merged_by_queue(text) == model.merged(text)
    for text in (" " * 5000 + "x", "the" * 2000 + "  of", " x  y" * 900):
        assert ids_of(piece_bpe.Encoder(model), text) == [*library.encode(text), END]


def test_decoding_any_ids(model, library):
    rng = random.Random(16)
    decoder = piece_bpe.Decoder(model)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_other_models_are_refused(model):
    other = proto.ModelProto()
    with open(PATH, "rb") as file:
        other.ParseFromString(file.read())
    other.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        piece_bpe.Model(other.SerializeToString())
    other.normalizer_spec.remove_extra_whitespaces = False
    other.pieces.add(piece="x ▁", score=-1e6)
    with pytest.raises(ValueError):
        piece_bpe.Model(other.SerializeToString())


def test_memos_are_bounded(model, monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS", 3)
    made = piece_bpe.Encoder(model)
    for text in (ENGLISH, GERMAN, ENGLISH):
        assert ids_of(made, text) == [*library.encode(text), END]
        assert len(made.memo) <= 3 and len(made.older) <= 3 and len(made.pairs) <= 3


def test_query_equals_library(spark, tmp_path, library):
    df = hard_documents(spark).unionByName(documents(spark, [(500 + i, t) for i, t in enumerate(MORE)]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for row in df.collect():
        ids = [*library.encode(row["text"] or ""), END]
        expected.append((str(row["doc_id"]), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    rows = queries.op13_piece_bpe(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted((str(r[names[0]]), *[r[c] for c in names[1:]]) for r in rows) == sorted(expected)


def test_empty_table_and_null_ids(spark, model):
    encode, decode = piece_bpe.encoder(model), piece_bpe.decoder(model)
    assert documents(spark, []).select(decode(encode(F.col("text")))).count() == 0
    row = documents(spark, [(1, None)]).select(decode(F.lit(None).cast("array<int>")).alias("none"),
                                               encode(F.col("text")).alias("ids")).first()
    assert row["none"] is None and row["ids"] == [END]

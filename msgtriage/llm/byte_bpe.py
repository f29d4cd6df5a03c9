"""Byte-level BPE through a sentencepiece model made from a rank file.

The rank file lists byte strings and their ranks. The model is written directly
from it: every byte becomes one printable character, every entry a piece whose
score is its negative rank, and the normaliser is the identity. A piece of text
between two cuts of the split pattern (a pre-token) is encoded by itself; as
sentencepiece merges the neighbours of best score first, and the leftmost of
equals, the result is that of merging by rank. An entry that equals a whole
pre-token is taken as it is. Decoding maps ids back to bytes.

Both directions work row by row, so there is no shuffle. A worker remembers the
ids of pre-tokens in a memo of bounded size. Null text is an empty text; it and
an empty text have no ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from msgtriage.llm.runs import slices

MEMO_ENTRIES = 120_000
#: Characters of text, or bytes of ids, whose results are handed over together, about.
SLICE = 1 << 22
MEMO_LENGTH = 64


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        entries = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in entries}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be gapless from 0")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> str:
    """A character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (0x100 + i for i in range(256))
    return "".join(chr(b) if b in own else chr(next(others)) for b in range(256))


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: piece 0 is the unknown piece, rank r is piece r + 1."""
    characters = byte_characters()
    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = 0
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").translate(dict(enumerate(characters))), score=-float(rank))
    return model.SerializeToString()


class Codec:
    """Encodes and decodes with one model; made in each worker, from what the plan carries."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        self.tokens, self.pattern, self.model = tokens, pattern, model or model_bytes(tokens)
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "model": self.model, "_ready": False}

    def _prepare(self) -> None:
        if not self._ready:
            self.cut = regex.compile(self.pattern).findall
            self.table = dict(enumerate(byte_characters()))
            self.rank = {token: i for i, token in enumerate(self.tokens)}
            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            #: The ids of pre-tokens met lately, and of those met before them: one that is met again moves up.
            self.memo: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
            self._ready = True

    def _ids(self, pre_token: str) -> bytes:
        found = self.older.get(pre_token)
        if found is None:
            raw = pre_token.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                found = whole.to_bytes(4, "little")
            else:
                pieces = self.pieces.encode(raw.decode("latin-1").translate(self.table))
                found = (np.array(pieces, "<i8") - 1).astype("<u4").tobytes()
        if len(pre_token) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            self.memo[pre_token] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        self._prepare()
        return b"".join([self.memo.get(x) or self._ids(x) for x in self.cut(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(codec: Codec):
    """A column function: text to its ids (binary, four little-endian bytes each)."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            for part in slices(texts, SLICE):
                yield pa.array([codec.encode(t) for t in texts[part]], pa.binary())

    def apply(text: Column) -> Column:
        return encode(text)

    return apply


def decoder(codec: Codec):
    """A column function: ids to the bytes of the text."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = [i or b"" for i in batch.to_pylist()]
            for part in slices(ids, SLICE):
                yield pa.array([codec.decode(i) for i in ids[part]], pa.binary())

    def apply(ids: Column) -> Column:
        return decode(ids)

    return apply

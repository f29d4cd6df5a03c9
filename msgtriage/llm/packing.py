"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows and takes its documents as
they come. Whatever fills a window by itself leaves at once. The rest goes to
the open window that it fits best; if it fits none and no further window may be
opened, the fullest one is topped up with the head of the rest (a document may
be cut anywhere) and emitted, and the tail goes on. At the end of the partition
the open windows are merged into full ones and one remainder. The remainders,
one per partition, are merged in rounds: a task takes those of ``FAN_IN``
neighbouring partitions and leaves one, until a single one remains. That one is
cut into sequences whose lengths are powers of two, which need no padding. So
there is no padding at all, and no task holds more than its open windows, or
``FAN_IN`` remainders.

There is no shuffle but that of the remainders. Pieces are stored once in the
shared folder, with their ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from msgtriage.llm.byte_bpe import byte_characters
from msgtriage.llm.common import materialize, text_or_empty
from msgtriage.llm.runs import slices

CAPACITY = 4096
OPEN_WINDOWS = 32
FAN_IN = 256
END_ID = 2
WIDTH = 4
#: Bytes of memo in a worker process, about, in each of two generations; what an entry takes besides its chunk and ids.
MEMO_BYTES = 32 << 20
ENTRY_BYTES = 180
MEMO_LENGTH = 64
#: Characters of text that are encoded together, about.
SLICE = 1 << 21

#: A round's sequences are numbered from ``number << SEQUENCE_BITS`` of their task.
SEQUENCE_BITS = 32
ROUND_BITS = 28

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, rest boolean"
PIECE_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "rest"]


class Tokens:
    """Ids of whole texts by a tokenizer file that drops white space.

    White space separates words in such a file, whatever stands beside it, so texts
    are split there and each chunk is encoded once. What is white space is told by
    the expression below, as in the file. Chunks of texts in common Latin letters are
    lower-cased and cut further, into the words of the file's pattern, which repeat
    more often and go to the merges one by one; where full stops and commas stand
    alone, they are parted from the words beforehand. A worker process remembers
    chunks and words in a memo of bounded size.
    """

    #: White space, and the word pattern of the tokenizer file.
    SPACE = r"\s+"
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What the str methods treat in another way: separators that are no white space there, and letters from
    #: U+0130 on, which composition may change or which do not lower-case one by one.
    ODD_ASCII = re.compile("[\x1c-\x1f]")
    ODD = re.compile("[\x1c-\x1f\u0130-\U0010ffff]")
    #: Where it isn't so that all characters are letters, white space, or single full stops and commas.
    TANGLED = re.compile("[^a-zà-öø-įªµº\\s.,]|[.,]{2}")

    def __init__(self, definition: str):
        self.definition = definition

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return _encoder(self.definition).encode_all(texts)


class _Encoder:
    """A tokenizer and what it is known to give."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize
        self.shown = dict(enumerate(byte_characters()))
        self.raw = [i.to_bytes(WIDTH, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.space = regex.compile(Tokens.SPACE)
        self.word = regex.compile(Tokens.WORD).findall
        #: What chunks met lately give, and what those before them gave: one that is met again moves up.
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain, other = set(), set()
        split = []
        for text in texts:
            if self._is_plain(text):
                text = text.lower()
                if not Tokens.TANGLED.search(text):
                    text = text.replace(",", " , ").replace(".", " . ")
                split.append(text.split())
                plain.update(split[-1])
            else:
                split.append([c for c in self.space.split(text) if c])
                other.update(split[-1])
        new = (plain | other) - self.chunks.keys()
        again = new & self.older.keys()
        self.chunks.update((c, self.older[c]) for c in again)
        new -= again
        self._learn(new & plain, new - plain)
        ids = self.chunks.__getitem__
        out = [b"".join(map(ids, chunks)) for chunks in split]
        for chunk in [c for c in new if len(c) > MEMO_LENGTH]:
            del self.chunks[chunk]
        self.held += sum(len(c) + ENTRY_BYTES for c in new) + ENTRY_BYTES * len(again)
        if self.held > MEMO_BYTES:
            self.chunks, self.older, self.held = {}, self.chunks, 0
        return out

    def _is_plain(self, text: str) -> bool:
        """Whether the str methods split and lower-case a text as the file says, and it names no special token."""
        odd = Tokens.ODD_ASCII if text.isascii() else Tokens.ODD
        return not odd.search(text) and not any(s in text for s in self.specials)

    def _learn(self, plain: set[str], other: set[str]) -> None:
        known = self.chunks
        for chunk in plain:
            if chunk.isalpha():
                known[chunk] = self._word(chunk)
        for chunk in plain:
            if not chunk.isalpha():
                known[chunk] = b"".join([known.get(w) or self.older.get(w) or self._word(w) for w in self.word(chunk)])
        known.update(zip(other, self._texts(list(other))))

    def _texts(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _word(self, word: str) -> bytes:
        """A word of the pattern goes to the merges as it is, its bytes as characters."""
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.merges(shown)])


@lru_cache(maxsize=2)
def _encoder(definition: str) -> _Encoder:
    """One for each definition and worker process."""
    return _Encoder(definition)


class Packer:
    """Open windows of one task. A window is a list of pieces (doc, start, ids, doc_tokens) and its free space."""

    def __init__(self, capacity: int, windows: int, first_sequence: int):
        self.capacity, self.windows, self.next = capacity, windows, first_sequence
        self.open: list[list] = []  # [free, pieces]

    def _emit(self, pieces: list[tuple], rest: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // WIDTH
            yield doc, start, length, ids, total, self.next, offset, rest
            offset += length
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Place the ids of a document (or of a part of it) and yield what has become full."""
        full = self.capacity * WIDTH
        at = 0
        while len(ids) - at >= full:
            yield from self._emit([(doc, start + at // WIDTH, ids[at:at + full], total)])
            at += full
        while at < len(ids):
            size = (len(ids) - at) // WIDTH
            fitting = [w for w in self.open if w[0] >= size]
            if fitting:
                window = min(fitting, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = [self.capacity, []]
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
                size = window[0]
            end = at + size * WIDTH
            window[1].append((doc, start + at // WIDTH, ids[at:end], total))
            window[0] -= size
            at = end
            if window[0] == 0:
                self.open.remove(window)
                yield from self._emit(window[1])

    def merge(self) -> Iterator[tuple]:
        """Fill up windows with the pieces of others until at most one is left open."""
        left = sorted(self.open, key=lambda w: w[0])
        self.open, self.windows = [], 1
        for _, pieces in left:
            for piece in pieces:
                yield from self.add(*piece)

    def remainder(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self._emit(pieces, rest=True)
        self.open = []

    def powers_of_two(self) -> Iterator[tuple]:
        """The open windows as sequences whose lengths are powers of two."""
        for _, pieces in self.open:
            queue = list(pieces)
            left = sum(len(p[2]) for p in queue) // WIDTH
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                sequence = []
                while room:
                    doc, start, ids, total = queue.pop(0)
                    size = min(room, len(ids) // WIDTH)
                    sequence.append((doc, start, ids[:size * WIDTH], total))
                    if size * WIDTH < len(ids):
                        queue.insert(0, (doc, start + size, ids[size * WIDTH:], total))
                    room -= size
                yield from self._emit(sequence)
        self.open = []


def _batches(rows: Iterable[tuple], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``limit`` bytes of ids."""
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=PIECE_NAMES)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size >= limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _merger(capacity: int, level: int, final: bool):
    """What a team of a round does: fill windows from the remainders of its members, in their order."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(capacity, 1, ((level << ROUND_BITS) + int(key[0])) << SEQUENCE_BITS)
        out: list[tuple] = []
        frame = frame.sort_values(["task", "sequence_id", "offset"])
        for doc, known, start, ids, total in zip(
                frame["doc_id"], frame["known"], frame["start"], frame["ids"], frame["doc_tokens"]):
            out += packer.add(int(doc) if known else None, int(start), ids, int(total))
        out += packer.powers_of_two() if final else packer.remainder()
        return pd.DataFrame(out, columns=PIECE_NAMES).astype({"doc_id": "Int64"})

    return merge


def pack(
    docs: DataFrame, tokens: Tokens, id_column: str = "doc_id", text_column: str = "text", *,
    capacity: int = CAPACITY, windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then ``END_ID``; a null text is
    empty, so its only id is that one. Rows that repeat are packed as often as
    they come. ``ids`` are little-endian unsigned 32-bit integers.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")
    end = np.array([END_ID], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            packer = Packer(capacity, windows, task << SEQUENCE_BITS)
            for batch in batches:
                docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for part in slices(texts, SLICE):
                    for doc, ids in zip(docs[part], tokens.encode_all(texts[part])):
                        ids += end
                        yield from packer.add(doc, 0, ids, len(ids) // WIDTH)
            yield from packer.merge()
            yield from packer.remainder()

        return _batches(rows())

    level = 0
    stored = materialize(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
        .mapInArrow(first, PIECES), "packed")
    done = [stored.where("not rest")]
    while True:
        # A remainder's place in line is the number of the task that left it.
        rest = stored.where("rest").withColumn(
            "task", F.shiftright("sequence_id", SEQUENCE_BITS).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)))
        last = rest.agg(F.max("task")).first()[0]
        if last is None:
            break
        level += 1
        final = last < FAN_IN

        grouped = rest.withColumn("known", F.col("doc_id").isNotNull()).withColumn(
            "doc_id", F.coalesce("doc_id", F.lit(0))).groupBy(F.floor(F.col("task") / FAN_IN).alias("team"))
        stored = materialize(grouped.applyInPandas(_merger(capacity, level, final), PIECES), "packed-rest")
        done.append(stored.where("not rest"))
        if final:
            break
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.drop("rest")

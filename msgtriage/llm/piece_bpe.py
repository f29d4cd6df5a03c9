"""Exact sentencepiece BPE by backtracking, and decoding.

A model of the merge type joins, again and again, the two neighbours whose
concatenation is the piece of best score (the leftmost of equals). The result can
be found from the left without merging the whole text. An Aho-Corasick automaton
gives the longest piece that begins at a character. It is taken if it is compatible
with the token before it: if merging the characters of both gives the two again. Else
the next shorter one that it begins with is tried. Where none is left, the position is
marked in a bitfield of positions that cannot be continued from, and the token
before it is taken back. As two neighbours that merging would not have left side
by side never are accepted, what reaches the end is the result of merging.

This holds where a piece scores worse than those it is merged from. Pieces that
merging their own characters does not give back are in no result and are left out
of the automaton. Runs of several spaces have pieces of one and the same score, so
their order decides and neighbours alone do not tell: a stretch with two spaces in
a row is merged in full instead, as is one that backtracking finds no way through.
Which pieces those are, where stretches of text may be cut (no piece crosses from
another character to a space, or has a letter beside what is none), and what the
normaliser does are read from the model; one with another normaliser than the
identity is an error.

Compatible pairs and the ids of stretches are kept in memos of bounded size for
the time of a task. Both directions work row by row, without a shuffle. A null
text is an empty one; it has no ids but the end. Characters that no piece has
become pieces of their bytes.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from msgtriage.llm.runs import slices

#: Fixed value: what stands for a space in pieces.
SPACE = "▁"
#: Fixed value: how the library shows an unknown piece.
UNKNOWN_SHOWN = " ⁇ "
#: Where a text is cut if no piece has a letter beside another character (but spaces in front), and where else.
BY_LETTERS = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+")
BY_SPACES = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
ALIKE = regex.compile(r"\p{L}+|\P{L}+")
#: Characters of text, or ids, whose results are handed over together, about.
SLICE = 1 << 21
MEMO_ENTRIES = 120_000
MEMO_LENGTH = 48
PAIRS = 200_000
#: Characters up to which neighbours are looked through at every merge.
SHORT = 64


def _one_mark_a_byte(error: UnicodeError):
    """Every byte that is no part of a character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("sentencepiece", _one_mark_a_byte)


class Model:
    """What a model file says: pieces, scores and ids. The plan carries this to the workers."""

    def __init__(self, serialised: bytes):
        model = proto.ModelProto()
        model.ParseFromString(serialised)
        kinds = proto.ModelProto.SentencePiece
        normal, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != proto.TrainerSpec.BPE or not trainer.byte_fallback:
            raise ValueError("the model must be of the merge type, with pieces for bytes")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("the normaliser must be the identity")
        if trainer.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces must be normal ones, with spaces in front")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.ids, self.scores, self.shown, self.starts, self.bytes = {}, {}, [], [], {}
        self.unknown = self.end = 0
        self.silent = []
        for i, piece in enumerate(model.pieces):
            shown = piece.piece.replace(SPACE, " ").encode()
            if piece.type == kinds.BYTE:
                value = int(piece.piece[3:-1], 16)
                self.bytes[value], shown = i, bytes([value])
            elif piece.type == kinds.UNKNOWN:
                self.unknown, shown = i, UNKNOWN_SHOWN.encode()
            elif piece.type == kinds.CONTROL:
                self.silent.append(i)
                shown = b""
                if piece.piece == trainer.eos_piece:
                    self.end = i
            else:
                self.ids[piece.piece], self.scores[piece.piece] = i, piece.score
            self.shown.append(shown)
            self.starts.append(piece.type == kinds.NORMAL and piece.piece.startswith(SPACE))
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("no piece may have a space behind another character")

        #: The two halves of each piece that merging its characters gives back; none of a single character.
        self.halves = {p: self._last_merge(p) for p in self.ids if len(p) == 1 or not p.startswith(SPACE * 2)}
        self.halves = {p: h for p, h in self.halves.items() if h is not None}

    def _last_merge(self, piece: str) -> tuple[str, ...] | None:
        """The symbols before the last merge; None if merging does not end in the piece."""
        symbols, before = list(piece), ()
        while len(symbols) > 1:
            at = self._best(symbols)
            if at is None:
                return None
            before = tuple(symbols)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return before

    def _best(self, symbols: list[str]) -> int | None:
        """Where the neighbours stand that merge next."""
        none = float("-inf")
        score = self.scores.get
        values = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        best = max(values)
        return values.index(best) if best > none else None

    @staticmethod
    def read(path: str) -> "Model":
        with open(path, "rb") as file:
            return Model(file.read())

    def merged(self, text: str) -> list[str]:
        """The result of merging the characters of a text, step by step."""
        if len(text) > SHORT:
            return self._merged_by_queue(text)
        symbols = list(text)
        while len(symbols) > 1:
            at = self._best(symbols)
            if at is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _merged_by_queue(self, text: str) -> list[str]:
        """The same for a long text: neighbours wait in a queue by score, then place."""
        n, score = len(text), self.scores.get
        end = list(range(1, n + 1))      # of the symbol that starts at a place; 0: none does
        before = list(range(-1, n - 1))  # the start of the symbol before
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            found = score(text[left:end[right]]) if end[right] - left <= self.longest else None
            if found is not None:
                heapq.heappush(queue, (-found, left, right, end[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, stop = heapq.heappop(queue)
            if end[left] != right or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                offer(left, stop)
            if before[left] >= 0:
                offer(before[left], left)
        return [text[i:e] for i, e in enumerate(end) if e]


class Encoder:
    """A model with its automaton and memos; made once a task.

    Tokens are numbers: the id of a piece, or, of a character that is no piece, its code point above all ids.
    """

    def __init__(self, model: Model):
        self.model = model
        self.pieces = len(model.shown)
        # Of the pieces of spaces alone, backtracking meets the single one only.
        usable = list(model.halves)
        self.texts = {model.ids[p]: p for p in usable}
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.matcher = ahocorasick.Automaton()
        for number, piece in self.texts.items():
            self.matcher.add_word(piece, number)
        self.matcher.make_automaton()
        known = set(usable)
        #: The longest piece that a piece begins with, other than itself; 0 (which no piece has): there is none.
        self.shorter = {number: next((model.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in known), 0)
                        for number, piece in self.texts.items()}
        self.sizes = {number: len(piece) for number, piece in self.texts.items()}
        self.raw = [i.to_bytes(4, "little") for i in range(self.pieces)]
        mixed = any(not ALIKE.fullmatch(p.lstrip(SPACE)) for p in model.ids if p.strip(SPACE))
        #: Stretches that are encoded by themselves.
        self.stretches = (BY_SPACES if mixed else BY_LETTERS).findall
        self.pairs: dict[int, bool] = {}
        #: The ids of stretches met lately, and of those met before them: what is met again moves up.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def text_of(self, token: int) -> str:
        return self.texts[token] if token < self.pieces else chr(token - self.pieces)

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (-1) edge of a piece while it is merged: symbols and their scores."""
        found = self.edges.get((piece, side))
        if found is None:
            halves = self.model.halves.get(piece, ())
            inner = self._edge(halves[side], side) if halves else []
            found = self.edges[piece, side] = [*inner, (piece, self.model.scores.get(piece, 0.0) if halves else 0.0)]
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both gives the two again.

        Merges away from the seam are those of each piece by itself, so only the symbols beside the seam are
        merged anew, best score first: the two are compatible if their join is never the next merge. Where a
        piece scores better than what it is merged from, the order is another, and all is merged anew.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.text_of(left), self.text_of(right)
        known = self.pairs[left << 32 | right] = self._apart(self._edge(a, -1), self._edge(b, 0))
        if known is None:
            known = self.pairs[left << 32 | right] = self.model.merged(a + b) == [a, b]
        return known

    def _apart(self, lefts: list[tuple[str, float]], rights: list[tuple[str, float]]) -> bool | None:
        score, none = self.model.scores.get, float("-inf")
        i = j = 0
        while True:
            next_left = lefts[i + 1][1] if i + 1 < len(lefts) else none
            next_right = rights[j + 1][1] if j + 1 < len(rights) else none
            if i and next_left > lefts[i][1] or j and next_right > rights[j][1]:
                return None
            join = score(lefts[i][0] + rights[j][0], none)
            # Of equal scores the one further left is next.
            if join > none and join > next_left and join >= next_right:
                return False
            if next_left == next_right == none:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def backtrack(self, stretch: str) -> list[int] | None:
        """The tokens of a stretch, or None if there is no way through."""
        n = len(stretch)
        sizes, shorter, pairs = self.sizes.get, self.shorter.get, self.pairs.get
        search, reach = self.matcher.iter_long, self.model.longest
        longest: dict[int, int] = {}
        taken: list[int] = []
        failed = bytearray(n // 8 + 1)
        at = before = 0
        while True:
            if at not in longest:
                stop, number = next(search(stretch[at:at + reach]), (0, 0))
                # A match that begins further on says that no piece begins here.
                longest[at] = number if number and sizes(number) == stop + 1 else self.pieces + ord(stretch[at])
            token = longest[at]
            while True:
                while token:
                    end = at + sizes(token, 1)
                    if not failed[end >> 3] >> (end & 7) & 1:
                        fits = not taken or pairs(before << 32 | token)
                        if fits is None:
                            fits = self._compatible(before, token)
                        if fits:
                            break
                    token = shorter(token, 0)
                if token:
                    break
                if not taken:
                    return None
                failed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                at -= sizes(token, 1)
                before = taken[-1] if taken else 0
                token = shorter(token, 0)
            taken.append(token)
            if end == n:
                return taken
            at, before = end, token

    def tokens(self, stretch: str) -> list[str]:
        """The pieces, and single characters that are none, of a stretch."""
        found = None if SPACE * 2 in stretch else self.backtrack(stretch)
        return self.model.merged(stretch) if found is None else [self.text_of(t) for t in found]

    def _of_texts(self, tokens: list[str]) -> bytes:
        """Ids of pieces, and of the bytes of characters that are none."""
        ids, byte, raw = self.model.ids, self.model.bytes, self.raw
        return b"".join([raw[ids[t]] if t in ids else b"".join([raw[byte.get(b, self.model.unknown)] for b in t.encode()])
                         for t in tokens])

    def _ids(self, stretch: str) -> bytes:
        found = self.older.get(stretch)
        if found is None:
            tokens = None if SPACE * 2 in stretch else self.backtrack(stretch)
            if tokens is None or max(tokens) >= self.pieces:
                found = self._of_texts(self.tokens(stretch))
            else:
                found = b"".join([self.raw[t] for t in tokens])
        if len(stretch) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            self.memo[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text and the end, as little-endian 32-bit integers."""
        end = self.model.end.to_bytes(4, "little")
        if not text:
            return end
        whole = self.model.prefix + text.replace(" ", SPACE)
        return b"".join([self.memo.get(s) or self._ids(s) for s in self.stretches(whole)]) + end


class Decoder:
    """The inverse mapping."""

    def __init__(self, model: Model):
        self.model, self.silent = model, frozenset(model.silent)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space that a text is given in front goes, control ids show nothing."""
        # Bytes on both sides of a control id belong to different characters.
        parts = [list(p) for quiet, p in groupby(ids, self.silent.__contains__) if not quiet]
        shown = self.model.shown.__getitem__
        text = "".join([b"".join(map(shown, p)).decode("utf-8", "sentencepiece") for p in parts])
        return text[1:] if self.model.prefix and parts and self.model.starts[parts[0][0]] else text


def encoder(model: Model):
    """A column function: text to its ids, with the end."""

    def apply(text: Column) -> Column:
        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made = Encoder(model)
            for batch in batches:
                texts = [t or "" for t in batch.to_pylist()]
                for part in slices(texts, SLICE):
                    rows = [made.encode(t) for t in texts[part]]
                    ends = np.cumsum([0, *map(len, rows)]) // 4
                    values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        return encode(text.cast("string"))

    return apply


def decoder(model: Model):
    """A column function: ids to the text; null has none."""

    def apply(ids: Column) -> Column:
        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made = Decoder(model)
            for rows in batches:
                ends, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
                known = rows.is_valid().to_numpy(zero_copy_only=False)
                first = 0
                while first < len(rows):
                    # As many rows as have the ids of a slice, but one at least.
                    after = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
                    yield pa.array([made.decode(values[ends[i]:ends[i + 1]].tolist()) if known[i] else None
                                    for i in range(first, after)], pa.string())
                    first = after

        return decode(ids)

    return apply

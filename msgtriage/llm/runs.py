"""Words and runs of punctuation of many texts at once, as 64-bit hashes, in numpy.

Texts are lower-cased and laid end to end as UTF-8. A word is a run of ASCII
letters, digits and underscores and of bytes beyond ASCII; what is neither that
nor ASCII white space is punctuation. A run's hash is a polynomial of its bytes
modulo 2^64, mixed; it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are laid end to end, about; a longer text comes alone.
SLICE_BYTES = 1 << 18

#: Bytes that the kept table of powers serves; few slices are longer.
TABLE_BYTES = 1 << 20

SPACE, WORD, PUNCTUATION = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers to 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _kinds() -> np.ndarray:
    kinds = np.full(256, PUNCTUATION, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z"), ("_", "_")):
        kinds[ord(low):ord(high) + 1] = WORD
    kinds[128:] = WORD
    return kinds


_KINDS = _kinds()
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """One for each worker process, 16 MB."""
    return _powers(TABLE_BYTES)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(count, _BASE), np.full(count, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive texts of about ``limit`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, size = i + 1, 0


def hashed_runs(texts: list[str], punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (and runs of punctuation) in order, and the number of the text of each."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    first = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    kinds = _KINDS[data]
    starts = np.flatnonzero(np.diff(kinds, prepend=np.uint8(255)))
    up, down = _table() if len(data) <= TABLE_BYTES else _powers(len(data))
    sums = np.add.reduceat(_VALUES[data] * up[:len(data)], starts)
    codes = mix(sums * down[starts] + np.diff(starts, append=len(data)).astype(np.uint64))
    kept = kinds[starts] != SPACE if punctuation else kinds[starts] == WORD
    starts, codes = starts[kept], codes[kept]
    return codes, np.searchsorted(first, starts, side="right") - 1

"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of consecutive words in which words ``q`` apart are identical,
``q`` being the least such number, that has at least ``max(LEAST, REPEATS * q)``
words and that no neighbouring word extends with the same period.

Every word of a run occurs in it at least ``REPEATS`` times. So a word that occurs
less often within a segment is in no run that lies in the segment, and splits it.
The parts are segments of their own, with counts of their own, and are split in
the same way until no segment has such a word; what has fewer than ``LEAST`` words
is dropped at once. A segment is counted again only after it was split. Prose is
nearly gone after a round or two; what survives is scanned lag by lag.

In the scan of a segment, a run of period ``q`` is a stretch of at least
``max(LEAST, REPEATS * q) - q`` places that equal the place ``q`` further on. Such
a stretch holds a certain number of consecutive multiples of any step, so a lag is
first probed at multiples of ``q``, then of ``q / 16``, and only a lag that passes
both is compared in full. Lags come in order, and a stretch inside a run whose
period divides the lag is that same run again. A period is the least one because
a shorter one would divide it and would have been found (Fine and Wilf).

Everything happens within a row: documents stay where they are and nothing is
shuffled. Words are runs of characters other than the six white-space characters
of ASCII. Null, empty and blank texts have no words, no runs and an empty
collapsed text; a text shorter than ``LEAST`` words has no runs. Texts that repeat
are treated one by one. Whole texts are scanned, however long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from msgtriage.llm.runs import slices

LEAST = 6
REPEATS = 4
#: Characters of text whose words are counted together, about.
SLICE = 1 << 20

RUN = ("start", "length", "period")
FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_TYPE = pa.struct([("runs", pa.list_(pa.struct([(name, pa.int64()) for name in RUN]))), ("collapsed", pa.string())])


def surviving_segments(words: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs, in order.

    ``words`` are numbers from 0, ``owners`` the number of the text of each word,
    ascending: texts are segments to begin with.
    """
    place, segment = np.arange(len(words)), owners.astype(np.int64)
    span = int(words.max()) + 1 if len(words) else 0
    starts, ends = [], []
    while len(place):
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        sizes = np.diff(first, append=len(place))
        _, inverse, occurs = np.unique(segment * span + words[place], return_inverse=True, return_counts=True)
        rare = occurs[inverse] < REPEATS
        split = np.logical_or.reduceat(rare, first)
        stable = ~split & (sizes >= LEAST)
        starts.append(place[first[stable]])
        ends.append(place[first[stable]] + sizes[stable])
        kept = np.repeat(split, sizes) & ~rare
        place, segment = place[kept], segment[kept]
        # A part ends where its segment ends or where a word has gone.
        part = np.cumsum((np.diff(segment, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1))
        long_enough = np.bincount(part)[part] >= LEAST if len(part) else np.zeros(0, bool)
        place, part = place[long_enough], part[long_enough]
        segment = np.cumsum(np.diff(part, prepend=-1) != 0)
    start, end = np.concatenate([*starts, np.zeros(0, int)]), np.concatenate([*ends, np.zeros(0, int)])
    order = np.argsort(start)
    return start[order].astype(int), end[order].astype(int)


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of truth of at least ``least`` places, as (start, end)."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    long_enough = edges[1::2] - edges[::2] >= least
    return list(zip(edges[::2][long_enough].tolist(), edges[1::2][long_enough].tolist()))


def scan_segment(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of one segment: (start, length, period)."""
    found: list[tuple[int, int, int]] = []
    for q in range(1, len(words) // REPEATS + 1):
        need = max(LEAST, REPEATS * q) - q
        here, further = words[:-q], words[q:]
        probe = here[::q] == further[::q]
        known = [(s, s + n - q) for s, n, p in found if q % p == 0 and n >= need + q]
        for a, b in known:
            probe[-(-a // q):-(-b // q)] = False
        if not _stretches(probe, need // q):
            continue
        step = max(1, q >> 4)
        if step < q and not _stretches(here[::step] == further[::step], need // step):
            continue
        for a, b in _stretches(here == further, need):
            if (a, b) not in known:
                found.append((a, b - a + q, q))
    return found


def runs_of(words: np.ndarray, owners: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of the words of several texts, by start, then period; a run never leaves its text."""
    runs = []
    for start, end in zip(*surviving_segments(words, owners)):
        runs += [(int(start) + s, n, q) for s, n, q in scan_segment(words[start:end])]
    return sorted(runs, key=lambda run: (run[0], run[2]))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; splitting bytes knows the white space of ASCII alone."""
    return (text or "").encode().split()


def analyse(texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """The runs of each text and the text without what they repeat, words joined by one space."""
    split = [split_words(t) for t in texts]
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(s) for s in split]
    words = np.fromiter((numbers[w] for s in split for w in s), np.int64, sum(sizes))
    owners = np.repeat(np.arange(len(split)), sizes)
    first = np.cumsum([0, *sizes])
    of_text: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for start, length, period in runs_of(words, owners):
        owner = int(owners[start])
        of_text[owner].append((start - int(first[owner]), length, period))
    for i, text_words in enumerate(split):
        runs = of_text.get(i, [])
        if runs:
            keep = np.ones(len(text_words), bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            text_words = [text_words[j] for j in np.flatnonzero(keep).tolist()]
        yield runs, b" ".join(text_words).decode()


def periodic_runs(text: Column) -> Column:
    """A struct of ``runs`` (by start, then period) and the ``collapsed`` text.

    A word is dropped from the collapsed text if a run holds it after the run's
    first ``period`` words.
    """

    @F.arrow_udf(FOUND)
    def analysed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [v or "" for v in texts.to_pylist()]
            done = [found for part in slices(values, SLICE) for found in analyse(values[part])]
            yield pa.array([{"runs": [dict(zip(RUN, run)) for run in runs], "collapsed": kept}
                            for runs, kept in done], _TYPE)

    return analysed(text.cast("string"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length; of equals the one with the smallest start, then period; null if none."""
    ordered = F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"),
        r["length"].alias("length")))
    return F.array_min(ordered)

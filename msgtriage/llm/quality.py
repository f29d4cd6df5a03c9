"""Quality by importance resampling over hashed n-grams.

Two bag models share one table of hashed word unigrams and bigrams: the target
model is counted over labelled good documents (a bounded sample of the labelled
rows, ``GOOD_DOCS``), the raw model over all documents. The importance weight of a document is the product of the ratios of
its features. Adding independent Gumbel noise to the logarithms and taking the k
largest draws k documents without replacement, in proportion to their weights.

k is not set by hand: it is the number of documents whose log weight is at least
``MARGIN``, counted over the whole table. Gumbel noise hardly falls below -2.7, so
documents of about the target's distribution stay and those far from it go.

The target model is the raw one, changed where the good documents show it: a
bucket's ratio is its count among them over the count that the raw model lets one
expect there, ``SMOOTHING`` added to both, and all are scaled to a distribution. So
features that were hardly seen say nothing for or against a document.

Counting is one pass with a table of ``BUCKETS`` numbers per task, which meet in
sums by bucket. The k-th largest value is found by counting, digit by digit, over
a sortable form of the perturbed weight; only ``RADIX`` counts reach the driver per
digit. The noise is a hash of the id, so a run can be repeated; equal values go by
the smaller id.

A null text is an empty text. An empty text has log weight 0. Without a labelled
good document all weights are 0, and all documents stay. Of a document's labels,
the largest counts; ids that are null have no label. Rows that repeat are drawn
like one another, for their noise is the same: all stay or all go, as far as ties
at the threshold allow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.llm.common import fresh, materialize, text_or_empty, uniform_of
from msgtriage.llm.runs import hashed_runs, mix, slices

BUCKETS = 1 << 14
MARGIN = -3.0
SMOOTHING = 20.0
SEED = 4
RADIX_BITS = 16
#: Good documents that the target model is counted over, about; bounds what is broadcast.
GOOD_DOCS = 20_000


class Features:
    """Buckets of unigrams and bigrams of words and runs of punctuation.

    All bigrams of a word with itself share a bucket.
    """

    def __init__(self, buckets: int):
        if buckets < 2 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all unigrams and bigrams, and the number of the text of each."""
        one, owner = hashed_runs(texts, punctuation=True)
        first, second = one[:-1], one[1:]
        two = np.where(first == second, np.uint64(1), mix(first + (second << np.uint64(1))))
        inside = owner[:-1] == owner[1:]
        codes = np.concatenate([one, two[inside]])
        return (codes & np.uint64(self.buckets - 1)).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def _counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: features of all rows (raw) and of the good ones (target)."""
    features = Features(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, good = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(texts):
                found, owner = features.of(texts[part])
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[part][owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    return rows.select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass(frozen=True)
class QualityModel:
    #: Log ratio of target to raw probability, per bucket.
    ratio: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
            buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> QualityModel:
        """Count the raw model over all of ``docs``, the target over those that ``labels`` calls good.

        ``labels`` has doc_id and quality (1 is good). Of the good ids about ``GOOD_DOCS`` are used, chosen
        by their hashes, so they can be sent to where the texts are, and no text moves.
        """
        good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
            F.max("quality").alias("quality")).where("quality = 1").select("label_id")
        share = GOOD_DOCS / max(1, good.count())
        chosen = F.broadcast(good.where(uniform_of(F.col("label_id").cast("string"), seed=SEED + 1) < share))
        narrow = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
        rows = narrow.join(chosen, F.col("id") == F.col("label_id"), "left").select(
            "text", F.col("label_id").isNotNull().alias("good"))
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for row in _counts(rows, buckets).collect():
            raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
        if not target.sum():
            return QualityModel(np.zeros(buckets))
        expected = target.sum() * raw / raw.sum()
        ratio = (target + smoothing) / (expected + smoothing)
        return QualityModel(np.log(ratio / (ratio * raw).sum() * raw.sum()))

    def column(self, text: Column) -> Column:
        """The log importance weight of a text column."""
        ratio, features = self.ratio, Features(len(self.ratio))

        @F.pandas_udf("double")
        def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in batches:
                texts = [t or "" for t in series]
                sums = []
                for part in slices(texts):
                    found, owner = features.of(texts[part])
                    sums.append(np.bincount(owner, ratio[found], minlength=part.stop - part.start))
                yield pd.Series(np.concatenate(sums) if sums else [], dtype=float)

        return weight(text)


def _sortable(value: Column) -> Column:
    """A non-negative long below 2^48 that orders as the double does, to a millionth (clamped at 10^8)."""
    clamped = F.greatest(F.least(value, F.lit(1e8)), F.lit(-1e8))
    return F.round((clamped + F.lit(1e8)) * F.lit(1e6)).cast("long")


def _threshold(rows: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest ``place``, and how many rows with that place are among the k."""
    low, left = 0, k
    for shift in (32, 16, 0):
        prefix = F.shiftright("place", shift + RADIX_BITS) == F.lit(low)
        digit = F.shiftright("place", shift).bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
        counts = {r["digit"]: r["n"] for r in rows.where(prefix).groupBy(digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= left:
                break
            left -= counts[digit]
        low = (low << RADIX_BITS) + digit
    return low, left


def resample(
    docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", *,
    k: int | None = None, margin: float = MARGIN, seed: int = SEED,
) -> DataFrame:
    """``docs`` with log_weight, perturbed and kept (names lengthened if taken)."""
    weight = fresh(docs, "log_weight")
    return draw(docs.withColumn(weight, model.column(F.col(text_column))), id_column, weight, k=k, margin=margin, seed=seed)


def draw(rows: DataFrame, id_column: str, weight: str, *, k: int | None = None, margin: float = MARGIN,
         seed: int = SEED) -> DataFrame:
    """``rows`` with perturbed and kept: ``k`` are kept, as given, or as many as have a weight of ``margin`` or more."""
    perturbed, kept, place = (fresh(rows, n) for n in ("perturbed", "kept", "place"))
    noise = -F.log(-F.log(uniform_of(F.col(id_column).cast("string"), seed=seed)))
    scored = materialize(
        rows.withColumn(perturbed, F.col(weight) + noise).withColumn(place, _sortable(F.col(perturbed))), "scored")
    places = scored.select(F.col(place).alias("place"), F.col(id_column).alias("id"))
    total, near = scored.agg(F.count(F.lit(1)), F.count(F.when(F.col(weight) >= margin, 1))).first()
    k = near if k is None else min(k, total)
    if k == total:
        return scored.withColumn(kept, F.lit(True)).drop(place)
    if k == 0:
        return scored.withColumn(kept, F.lit(False)).drop(place)
    cut, among = _threshold(places, k)
    # Ties at the cut: the smaller ids, as many as are still wanted, are found by count and not by a sort.
    tied = places.where(F.col("place") == cut)
    last = _nth_id(tied, among)
    inside = (F.col(place) > cut) | ((F.col(place) == cut) & last(F.col(id_column)))
    return scored.withColumn(kept, F.coalesce(inside, F.lit(False))).drop(place)


def _nth_id(tied: DataFrame, wanted: int):
    """A condition on the id that holds for the ``wanted`` smallest of the tied (all rows of the last id; no null)."""
    if tied.count() == wanted:
        return lambda column: F.lit(True)
    low, high = tied.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return lambda column: F.lit(False)
    while low < high:
        middle = (low + high) // 2
        if tied.where(F.col("id") <= middle).count() >= wanted:
            high = middle
        else:
            low = middle + 1
    return lambda column: column <= F.lit(high)


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    model = QualityModel.fit(docs, labels, id_column, text_column)
    drawn = resample(docs, model, id_column, text_column)
    kept = next(c for c in reversed(drawn.columns) if c not in docs.columns)
    return drawn.where(F.col(kept)).select(*docs.columns)

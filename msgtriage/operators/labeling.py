"""Weak labels and label rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.functions.rules import Rule, first_match, lexicon_label
from msgtriage.functions.text import (
    contains_any, repair_text, strip_leading_handle, trim_whitespace, word_count,
)
from msgtriage.operators.limits import first_n

WEAK_MIN_LENGTH = 20      # fixed value: weak labels need more than this many characters
TRAINING_CAP = 5_000      # fixed value: training rows including seeds
FRAGMENT_WORDS = 2        # fixed value
FRAGMENT_CONFIDENCE = 0.98
OUT_OF_SCOPE_CONFIDENCE = 0.95

Lexicon = Sequence[tuple[str, Sequence[str]]]


def with_label(df: DataFrame, lexicon: Lexicon, text: str, label: str = "intent") -> DataFrame:
    """The first-match label of ``text``; null where no entry matches."""
    lowered = df.withColumn("_lower", F.lower(F.col(text)))
    return lowered.withColumn(label, lexicon_label("_lower", lexicon)).drop("_lower")


def weak_labels(
    corpus: DataFrame, lexicon: Lexicon, text: str = "customer_text",
    min_length: int = WEAK_MIN_LENGTH,
) -> DataFrame:
    """G1: corpus rows that a keyword labels and that are long enough."""
    long_enough = corpus.where(F.char_length(F.col(text)) > min_length)
    return with_label(long_enough, lexicon, text).where(F.col("intent").isNotNull())


def seed_union(
    seeds: DataFrame, corpus: DataFrame, columns: Sequence[str], key: str,
) -> DataFrame:
    """Seeds before corpus rows, by a ``priority`` column."""
    return seeds.select(F.lit(0).alias("priority"), key, *columns).unionByName(
        corpus.select(F.lit(1).alias("priority"), key, *columns)
    )


def training_set(
    seeds: DataFrame, corpus: DataFrame, lexicon: Lexicon, text: str = "customer_text",
    key: str = "id", cap: int = TRAINING_CAP,
) -> DataFrame:
    """All seeds, then weakly labelled corpus rows by key, up to ``cap`` rows in all.

    Like the pair cap, only keys are sorted to find where the corpus part ends.
    """
    columns = [text, "intent"]
    labelled = weak_labels(corpus, lexicon, text)
    room = max(cap - seeds.count(), 0)
    return seed_union(seeds, first_n(labelled, key, room) if room else labelled.limit(0), columns, key)


def stratum_of(df: DataFrame, rules: Sequence[Rule], default: dict, text: str) -> DataFrame:
    """Escalation flag, its reason and the difficulty stratum of a labelled row."""
    names = {"text": "_lower", "intent": "intent"}
    return (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("_s", first_match(rules, names, default))
        .select(*df.columns, "_s.*")
    )


def rule_labelled_items(
    corpus: DataFrame, lexicon: Lexicon, text: str, low: int, high: int,
) -> DataFrame:
    """G3 with F6 and B4: repaired texts inside the length band that a rule labels."""
    repaired = corpus.withColumn(text, repair_text(text))
    in_band = repaired.where(F.char_length(F.col(text)).between(low, high))
    return with_label(in_band, lexicon, text).where(F.col("intent").isNotNull())


def is_fragment(text: Column, phrases: Sequence[str]) -> Column:
    """Without a leading handle, at most two words and exactly a listed phrase."""
    bare = trim_whitespace(strip_leading_handle(F.lower(trim_whitespace(text))))
    # The list test comes first: few texts pass it, so few are split into words.
    return bare.isin(list(phrases)) & (word_count(bare) <= FRAGMENT_WORDS)


def is_out_of_scope(text: Column, needles: Sequence[str]) -> Column:
    """Names something outside the domain."""
    return contains_any(F.lower(text), needles)


def heuristic_intent(
    text: Column, phrases: Sequence[str], needles: Sequence[str],
    fragment_label: str, out_of_scope_label: str,
) -> Column:
    """A struct (intent, confidence) where G5 or, after it, G6 holds; null elsewhere."""
    def pair(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("intent"), F.lit(confidence).alias("confidence"))

    return F.when(is_fragment(text, phrases), pair(fragment_label, FRAGMENT_CONFIDENCE)).when(
        is_out_of_scope(text, needles), pair(out_of_scope_label, OUT_OF_SCOPE_CONFIDENCE)
    )

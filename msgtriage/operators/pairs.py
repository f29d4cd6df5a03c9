"""From raw messages to a corpus of (message, reply) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.functions.text import collapse_whitespace, trim_whitespace
from msgtriage.operators.limits import first_n

MIN_TEXT = 15          # fixed value: shortest usable text of a pair
LENGTH_BAND = (20, 260)  # fixed value: texts fit for the evaluation set


def is_relevant(author: Column, text: Column, brand: str, handle: str) -> Column:
    """B1: written by the brand, or mentions its handle in any case; null text does not."""
    mentions = F.coalesce(F.contains(F.lower(text), F.lit(handle.lower())), F.lit(False))
    return F.coalesce(author == brand, F.lit(False)) | mentions


def filter_relevant(messages: DataFrame, brand: str, handle: str) -> DataFrame:
    return messages.where(is_relevant(F.col("author_id"), F.col("text"), brand, handle))


def min_length(columns: Sequence[str], at_least: int = MIN_TEXT) -> Column:
    """Every named text has at least so many characters."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.char_length(F.col(c)) >= at_least)
    return test


def length_band(c: str, low: int = LENGTH_BAND[0], high: int = LENGTH_BAND[1]) -> Column:
    """Length between both bounds, inclusive."""
    return F.char_length(F.col(c)).between(low, high)


def _sides(messages: DataFrame, brand: str, handle: str | None) -> tuple[DataFrame, DataFrame]:
    """B2: replies by the brand, and inbound messages; each filtered and cleaned before any shuffle.

    C2: ids are made unique on both sides. Of messages that repeat an id, the one with the least
    parent and text stands; the minimum is taken before the shuffle, so a hot id is one row a partition.
    """
    relevant = messages if handle is None else filter_relevant(messages, brand, handle)
    replies = relevant.where(
        (F.col("author_id") == brand) & ~F.col("inbound")
        & F.col("in_response_to_tweet_id").isNotNull()
    ).select(
        F.col("in_response_to_tweet_id").alias("inquiry_id"),
        F.col("tweet_id").alias("response_id"),
        collapse_whitespace("text").alias("agent_text"),
    )
    inquiries = relevant.where(F.col("inbound")).select(
        F.col("tweet_id").alias("inquiry_id"), collapse_whitespace("text").alias("customer_text")
    )
    replies = replies.where(min_length(["agent_text"])).groupBy("response_id").agg(
        F.min(F.struct("inquiry_id", "agent_text")).alias("r")).select("response_id", "r.*")
    inquiries = inquiries.where(min_length(["customer_text"])).groupBy("inquiry_id").agg(
        F.min("customer_text").alias("customer_text"))
    return replies, inquiries


PAIR_COLUMNS = ("inquiry_id", "response_id", "customer_text", "agent_text")


def reply_pairs(messages: DataFrame, brand: str, handle: str | None = None) -> DataFrame:
    """Each brand reply with the inbound message it answers, both long enough.

    A message with very many replies makes one side of the sort-merge join
    skewed; adaptive execution splits it.
    """
    replies, inquiries = _sides(messages, brand, handle)
    return replies.join(inquiries, "inquiry_id").select(*PAIR_COLUMNS)


def dedup_keep_first(df: DataFrame, text: str, key: str) -> DataFrame:
    """D3: per distinct text the row with the lowest ``key``.

    The minimum is taken before the shuffle, so a text that makes up a third of
    all rows travels once per partition. Grouping by the hash first lets the
    sort compare eight bytes instead of the text.
    """
    columns = df.columns
    rest = [c for c in columns if c != text]
    first = (
        df.groupBy(F.xxhash64(text).alias("_hash"), text)
        .agg(F.min_by(F.struct(*rest), key).alias("_first"))
    )
    return first.select(*[F.col(c) if c == text else F.col(f"_first.{c}").alias(c) for c in columns])


def capped_pairs(
    messages: DataFrame, brand: str, handle: str | None = None, max_pairs: int | None = None,
) -> DataFrame:
    """The first pairs by reply id up to the cap, if one is given, then D3 (so the result is smaller)."""
    pairs = reply_pairs(messages, brand, handle)
    if max_pairs is not None:
        pairs = first_n(pairs, "response_id", max_pairs)
    return dedup_keep_first(pairs, "customer_text", "response_id")


def build_corpus(messages: DataFrame, brand: str, handle: str | None = None) -> DataFrame:
    """C1 and D3 in one, without a cap.

    Only the earliest usable reply of a message can survive D3, so replies are
    reduced to one per message before the join: nothing skewed reaches it.
    """
    replies, inquiries = _sides(messages, brand, handle)
    earliest = replies.groupBy("inquiry_id").agg(
        F.min_by(F.struct("response_id", "agent_text"), "response_id").alias("r")
    )
    pairs = earliest.join(inquiries, "inquiry_id").select(
        "inquiry_id", "r.response_id", "customer_text", "r.agent_text"
    )
    return dedup_keep_first(pairs, "customer_text", "response_id")


def drop_leaked(
    corpus: DataFrame, evaluation: DataFrame, key: str, text: str = "customer_text",
    evaluation_text: str = "customer_text", salts: int = 16,
) -> DataFrame:
    """Corpus rows whose text, without whitespace at its ends, is not an evaluation text.

    A null text is empty, so it is one of them only if an evaluation text is empty too.
    Whether to broadcast the evaluation keys is left to the size check of the
    planner. If it shuffles, the corpus is salted by its row ``key``, so a text
    that fills a third of the corpus is spread over ``salts`` tasks; the
    de-duplicated evaluation keys are repeated per salt, as SHA-256 digests, since
    whole texts repeated so often would be far more than the corpus.
    """
    def digest(c: str) -> Column:
        return F.unhex(F.sha2(trim_whitespace(c), 256)).alias("_key")

    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    keys = evaluation.select(digest(evaluation_text)).distinct().select("_key", salt)
    salted = corpus.withColumn("_key", digest(text)).withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    )
    return salted.join(keys, ["_key", "_salt"], "left_anti").drop("_key", "_salt")


def find_leaked(
    corpus: DataFrame, evaluation: DataFrame, text: str = "customer_text",
    evaluation_text: str = "customer_text",
) -> DataFrame:
    """C3, the other half: the corpus rows that ``drop_leaked`` removes."""
    keys = evaluation.select(trim_whitespace(evaluation_text).alias("_key")).distinct()
    return corpus.withColumn("_key", trim_whitespace(text)).join(keys, "_key", "left_semi").drop("_key")

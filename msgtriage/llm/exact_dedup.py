"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the input makes a run: its digests in order, each with a
count and the row that would stay. Runs then merge in rounds. In a round, the
runs whose numbers agree but for the last ``log2(fan_in)`` bits become one
(binomial rounds; with ``fan_in=2`` pairs). Every level unites two entries only
if digest, byte length and an independent checksum of the text all agree, and
retains the row with the winning identifier. The winner then travels back down
the same tree, to the rows.

A digest that a third of all rows share is one entry per run from the start, so
no round and no join ever gathers its rows: a merge sees at most ``fan_in``
entries of a digest, and the last join has the run in its key. Each level is a
table in the shared folder, so a lost executor costs the round it is in.

Null text is an empty text. A null identifier loses to any other. Rows that
repeat an identifier and a text are copies like others; exactly one row of a
group has ``kept``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.llm.common import ascii_lower, materialize, text_or_empty

RUN, TAG, DIGEST, BYTES, CHECK = "run", "tag", "digest", "bytes", "checksum"
KEY = (DIGEST, BYTES, CHECK)
FAN_IN = 16


def _digests(df: DataFrame, id_column: str, text_column: str, carry: tuple[str, ...]) -> DataFrame:
    """One row per input row: run, tag (unique), id, digest; and the columns named in ``carry``."""
    text = ascii_lower(text_or_empty(text_column))
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = df.select(F.col(id_column).alias("id"), text.alias("norm"), carried.alias("carried"))
    return materialize(rows.select(
        F.spark_partition_id().alias(RUN), F.monotonically_increasing_id().alias(TAG), "id",
        F.unhex(F.sha2("norm", 256)).alias(DIGEST), F.octet_length("norm").alias(BYTES),
        F.xxhash64("norm").alias(CHECK), "carried",
    ), "digest-rows")


def _merge(entries: DataFrame, run: Column, best: Column, count: Column) -> DataFrame:
    """Unite the entries of a digest within each new run; every run comes out in order."""
    merged = entries.groupBy(run.alias(RUN), *KEY).agg(F.max(best).alias("best"), F.sum(count).alias("n"))
    return materialize(merged.sortWithinPartitions(RUN, *KEY), "digest-run")


def exact_groups(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
    keep: str = "smallest", fan_in: int = FAN_IN, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest, carried.

    Identifiers are numbers. ``keep`` names the one that stays, "smallest" or "largest";
    ``fan_in``, a power of two, how many runs one round makes one. ``carry``
    names input columns that the result holds in a struct.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    bits = fan_in.bit_length() - 1
    if fan_in < 2 or fan_in != 1 << bits:
        raise ValueError("fan_in must be a power of two")
    rows = _digests(df, id_column, text_column, carry)
    # The winner is a maximum: of (known, order, tag). For numbers, order is the id or its negative.
    order = F.col("id") if keep == "largest" else -F.col("id")
    candidate = F.struct(F.col("id").isNotNull().alias("known"), order.alias("order"), (-F.col(TAG)).alias("late"),
                         F.col("id").alias("id"))
    levels = [_merge(rows, F.col(RUN), candidate, F.lit(1))]
    width = (rows.agg(F.max(RUN)).first()[0] or 0) + 1
    while width > 1:
        levels.append(_merge(levels[-1], F.shiftright(RUN, bits), F.col("best"), F.col("n")))
        width = -(-width // fan_in)
    # Down again: only groups of two or more have anything to tell.
    top = levels.pop().where("n > 1")
    while levels:
        lower = levels.pop().select(F.col(RUN).alias("below"), F.shiftright(RUN, bits).alias(RUN), *KEY)
        top = lower.join(top, [RUN, *KEY]).select(F.col("below").alias(RUN), *KEY, "best", "n")
    # Hashing the small side spares sorting rows that may carry whole texts.
    told = rows.join(top.hint("shuffle_hash"), [RUN, *KEY], "left")
    single = F.col("n").isNull()
    return told.select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.late") == -F.col(TAG))).alias("kept"),
        F.col(DIGEST).alias("digest"), "carried",
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                      keep: str = "smallest") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    groups = exact_groups(docs, id_column, text_column, keep=keep, carry=tuple(docs.columns))
    return groups.where("kept").select("carried.*")


__all__ = ["drop_exact_copies", "exact_groups"]

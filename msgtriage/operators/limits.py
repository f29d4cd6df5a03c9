"""Ordered caps, keys and ids.

Storage order means nothing in Spark, so every "first" takes an explicit key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from msgtriage.session import materialize


#: So many keys may be sorted to find a cut among them.
FEW_KEYS = 50_000


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the ``n`` lowest values of the unique ``key``.

    The rows are stored once, so that what makes them runs once, and pass a filter
    where they are. The cut is found by counting the keys of ranges: of the range
    that holds the ``n``-th key the keys are dealt to ranges again, until few are
    left. No task ever holds ``n`` keys, however large ``n`` is.
    """
    stored = materialize(df, "ordered")
    if n < 1:
        return stored.where("false")
    keys, room = stored.select(key).where(F.col(key).isNotNull()), n
    size = keys.count()
    while size > max(FEW_KEYS, 1) and room < size:
        ranges = materialize(keys.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "key-ranges")
        # One row per task.
        counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
        before = 0
        for number, held in counts:
            if before + held >= room:
                break
            before += held
        if held == size:    # one range took all: the keys are not unique
            break
        keys, room, size = ranges.where(F.col("_range") == number).select(key), room - before, held
    if room >= size:
        cut = keys.agg(F.max(key)).first()[0]
    else:
        cut = keys.orderBy(key).limit(room).agg(F.max(key)).first()[0]
    return stored.where(F.col(key) <= F.lit(cut))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def number_rows(small: DataFrame, key: str, id_col: str = "id", start: int = 1) -> DataFrame:
    """E5: consecutive ids in key order, for results already limited to a few rows."""
    position = F.row_number().over(Window.orderBy(key))
    return small.withColumn(id_col, (position + F.lit(start - 1)).cast("long"))


def number_all(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """E5: consecutive ids from 1 in the order of the unique ``key``, for any number of rows.

    Ranges of the key are numbered by themselves; only their counts meet.
    """
    ranges = materialize(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranges.withColumn("_position", position).join(F.broadcast(offsets), "_range").withColumn(
        id_col, (F.col("_position") + F.col("_offset")).cast("long")).drop("_range", "_position", "_offset")


def sample_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows shown first."""
    return df.orderBy(key).limit(n)

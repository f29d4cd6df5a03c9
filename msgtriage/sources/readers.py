"""Scans (A1-A4, A8). Every reader declares its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from msgtriage import schemas
from msgtriage.operators.limits import first_n
from msgtriage.sources.contract import open_input


def _csv(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """A file whose texts hold line breaks is one task; without such, ``multi_line=False`` lets Spark split it."""
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("multiLine", multi_line).option("escape", '"').csv(path)


def read_raw_messages(
    spark: SparkSession, path: str, max_rows: int | None = None, multi_line: bool = True,
) -> DataFrame:
    """A1: the raw message dump. ``max_rows`` keeps the lowest message ids.

    A large dump is best read once and kept as Parquet (``ingest_messages``).

    The parent id may be written as a whole float (``12.0``), since it can be
    missing; it is read as text and made a LONG, exact for any id.
    """
    parent = "in_response_to_tweet_id"
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == parent else f.dataType)
        for f in schemas.RAW_MESSAGES
    ])
    raw = open_input(lambda: _csv(spark, path, as_text, multi_line), "the download of the raw messages")
    whole = F.regexp_replace(F.col(parent), r"\.0*$", "")
    df = raw.withColumn(parent, whole.try_cast("long"))
    return df if max_rows is None else first_n(df, "tweet_id", max_rows)


def ingest_messages(spark: SparkSession, path: str, to: str, multi_line: bool = True) -> DataFrame:
    """A1 once and for all: the dump as Parquet, which splits whatever its texts hold."""
    read_raw_messages(spark, path, multi_line=multi_line).write.mode("overwrite").parquet(to)
    return spark.read.schema(schemas.RAW_MESSAGES).parquet(to)


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: the pair corpus without rows that lack a text."""
    def load() -> DataFrame:
        if fmt == "csv":
            return _csv(spark, path, schemas.PAIRS)
        return spark.read.schema(schemas.PAIRS).format(fmt).load(path)

    return drop_incomplete_pairs(open_input(load, "the pair extraction"))


def drop_incomplete_pairs(
    df: DataFrame, customer: str = "customer_text", agent: str = "agent_text",
) -> DataFrame:
    return df.na.drop(subset=[customer, agent])


def read_evaluation_items(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A3: the labelled evaluation set; JSON may be an array or one object per line.

    ``fmt="jsonl"`` says that it is one object per line, so that Spark may split the files.
    """
    def load() -> DataFrame:
        if fmt == "csv":
            return _csv(spark, path, schemas.EVALUATION_ITEMS)
        reader = spark.read.schema(schemas.EVALUATION_ITEMS)
        if fmt == "jsonl":
            return reader.json(path)
        if fmt == "json":
            reader = reader.option("multiLine", True)
        return reader.format(fmt).load(path)

    return open_input(load, "the evaluation set builder")


def read_calibration(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A4: two raters' scores, as one row per item and dimension."""
    raw = open_input(
        lambda: spark.read.schema(schemas.CALIBRATION).option("multiLine", multi_line).json(path),
        "the calibration study",
    )
    return stack_ratings(raw)


def stack_ratings(raw: DataFrame) -> DataFrame:
    """Nested scores to ``(item_id, dimension, rater_a, rater_b)``."""
    cells = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(f"human_scores.{d}").alias("rater_a"),
            F.col(f"judge_scores.{d}").alias("rater_b"),
        )
        for d in ("groundedness", "actionability", "brand_tone")
    ]
    return raw.select(F.col("id").alias("item_id"), F.inline(F.array(*cells)))


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table of a few files, spread over the cores by key.

    Text work is bound by the CPU, and a file of one row group is read by one task.
    A large table comes in many files, has tasks enough, and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored detailed predictions."""
    def load() -> DataFrame:
        if fmt == "csv":
            return _csv(spark, path, schemas.DETAILED_PREDICTIONS)
        return spark.read.schema(schemas.DETAILED_PREDICTIONS).format(fmt).load(path)

    return open_input(load, "the evaluation")


def read_metrics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The stored long metric table."""
    return open_input(
        lambda: spark.read.schema(schemas.METRICS).format(fmt).load(path), "the evaluation"
    )

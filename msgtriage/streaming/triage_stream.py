"""The triage plan over an unbounded table of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from msgtriage.operators.retrieval import CaseIndex
from msgtriage.packs import TriagePack
from msgtriage.plans.triage import classify_and_decide, production_triage


def read_message_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A directory (or pattern) of files as a stream of raw rows."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drop_repeated(messages: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """A message whose id was seen no longer than ``delay`` before is dropped.

    The ids are state, dealt by id, kept in the state store until ``delay`` after their ``time``;
    so the state is bounded, and a stream that is started again still knows them.
    """
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def decide_stream(messages: DataFrame, model, pack: TriagePack) -> DataFrame:
    """The narrow half of the plan, stateless: it runs inside the stream as it is."""
    return classify_and_decide(messages, model, pack)


def triage_stream(
    messages: DataFrame, model, index: CaseIndex, pack: TriagePack, output: str, checkpoint: str,
    finish: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True,
) -> StreamingQuery:
    """Score each micro-batch with the batch plan and write it under its batch number.

    The search ranks, which a stream cannot, so it runs per micro-batch against
    the same stored index. A batch that is run again after a failure overwrites
    its own folder, so every message is written exactly once.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        scored = finish(production_triage(batch, model, index, pack))
        scored.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


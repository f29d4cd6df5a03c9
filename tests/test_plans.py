"""Triage plans, their evaluation, and the stream."""

import pytest
from pyspark.sql import functions as F

from msgtriage.operators.classify import Constant, LinearWeights
from msgtriage.operators.retrieval import CaseIndex
from msgtriage.operators.tfidf import TfidfConfig
from msgtriage.packs import support
from msgtriage.plans import evaluation, triage
from msgtriage.streaming.triage_stream import decide_stream, drop_repeated, read_message_stream, triage_stream

CORPUS = [
    (1, "my phone is slow after the update", "Try restarting the phone and tell us how it goes, @123."),
    (2, "how to print a photo book", "Short."),
]
MESSAGES = [
    (1, "phone is slow since yesterday"), (2, "print a photo book please"), (3, "zzz"),
    (4, "my charger is burning"), (5, "yes"), (6, "give me my refund, bank"), (7, None),
]
MODEL = LinearWeights({support.SOFTWARE: {"slow": 3.0}, support.BILLING: {"refund": 4.0}, support.REPAIR: {}})


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(CORPUS, "inquiry_id long, customer_text string, agent_text string")
    return CaseIndex.build(df, TfidfConfig(1, 2, 100, sublinear=True))


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES, "id long, customer_text string")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_trivial(messages):
    rows = by_id(triage.trivial_triage(messages, support.PACK))
    assert len(rows) == 7 and {r["intent"] for r in rows.values()} == {support.SOFTWARE}
    assert not any(r["should_escalate"] for r in rows.values())


def test_simple(messages, index):
    rows = by_id(triage.simple_triage(messages, MODEL, index, support.PACK))
    assert rows[1]["drafted_reply"] == CORPUS[0][2]
    assert rows[3]["drafted_reply"] == "We are here to help. Send us a DM."
    assert rows[6]["should_escalate"] and rows[6]["risk_level"] == "MEDIUM"


def test_production(messages, index):
    rows = by_id(triage.production_triage(messages, MODEL, index, support.PACK))
    assert len(rows) == 7
    assert rows[1]["trigger_rule"] == "AUTO_RESOLVE_ROUTINE"
    assert rows[1]["drafted_reply"] == "Try restarting the phone and tell us how it goes, ."
    assert rows[4]["trigger_rule"] == "SAFETY_PHYSICAL_HAZARD"
    assert rows[5]["intent"] == support.FRAGMENT and rows[5]["confidence"] == 0.98
    assert rows[6]["trigger_rule"] == "POLICY_BILLING_DISPUTE"
    assert rows[3]["trigger_rule"] == "CONFIDENCE_UNCERTAINTY" and rows[3]["retrieved"] == []
    assert triage.output_columns(triage.production_triage(messages, MODEL, index, support.PACK)).columns[0] == "id"


def test_without_a_model(messages, index):
    rows = by_id(triage.production_triage(messages, None, index, support.PACK))
    assert rows[1]["intent"] == support.SOFTWARE and rows[1]["confidence"] == 0.5


def test_metric_table(spark, messages, index):
    gold = messages.where("customer_text is not null").select(
        "id", "customer_text", F.lit(support.SOFTWARE).alias("intent"),
        (F.col("id") == 4).alias("should_escalate"), F.lit("r").alias("escalation_reason"),
        F.lit("s").alias("difficulty_stratum"), F.lit("Try restarting the phone").alias("reference_resolution"))
    answers = triage.production_triage(gold.select("id", "customer_text"), MODEL, index, support.PACK)
    predictions = evaluation.evaluate_system("production", gold, answers, support.PACK)
    assert predictions.count() == 6
    table = evaluation.metric_table(evaluation.evaluation_cube(predictions))
    values = {(r["metric_group"], r["metric"], r["label"]): r["value"] for r in table.collect()}
    assert values["escalation", "tp", None] == 1.0 and values["escalation", "fn", None] == 0.0
    assert values["per_class", "support", support.SOFTWARE] == 6.0
    assert values["intent", "accuracy", None] == pytest.approx(
        predictions.where("intent_match").count() / 6, abs=1e-4)
    mean = predictions.agg(F.avg("judge_overall")).first()[0]
    assert values["rubric", "judge_overall", None] == round(mean, 2)
    lexical = {r["metric"]: r["value"] for r in evaluation.lexical_metrics("production", answers, gold).collect()}
    assert set(lexical) == {"bleu_4", "rouge_l", "cosine_similarity"} and lexical["rouge_l"] > 0


def test_stream_equals_batch_over_many_batches(spark, messages, index, tmp_path):
    for i in range(3):
        messages.where(F.pmod("id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_message_stream(spark, str(tmp_path / "in"), messages.schema, max_files=1)
    columns = ["id", "intent", "trigger_rule", "drafted_reply", "retrieval_score"]
    run = triage_stream(
        stream, MODEL, index, support.PACK, str(tmp_path / "out"), str(tmp_path / "cp"),
        finish=lambda df: df.select(*columns))
    run.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("batch").distinct().count() == 3
    batch = triage.production_triage(messages, MODEL, index, support.PACK).select(*columns)
    assert sorted(map(str, written.select(*columns).collect())) == sorted(map(str, batch.collect()))


def test_decisions_run_inside_the_stream(spark, messages, tmp_path):
    messages.write.parquet(str(tmp_path / "in"))
    stream = read_message_stream(spark, str(tmp_path / "in"), messages.schema)
    decided = decide_stream(stream, Constant(support.SOFTWARE, 0.9), support.PACK).select("id", "trigger_rule")
    run = decided.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_repeated_messages_are_answered_once_after_a_restart(spark, messages, index, tmp_path):
    """Ids come again in the same batch, in a later one, and after the stream was started anew."""
    columns = ["id", "intent", "trigger_rule", "drafted_reply"]

    def arrive(ids):
        messages.where(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = read_message_stream(spark, str(tmp_path / "in"), messages.schema, max_files=1)
        once = drop_repeated(stream.withColumn("seen", F.current_timestamp()), "id", "seen", "1 hour").drop("seen")
        triage_stream(once, MODEL, index, support.PACK, str(tmp_path / "out"), str(tmp_path / "cp"),
                      finish=lambda df: df.select(*columns)).awaitTermination()

    arrive([1, 2, 3])
    arrive([2, 3, 4])
    run()
    arrive([1, 4, 5, 6, 7])
    run()
    batch = triage.production_triage(messages, MODEL, index, support.PACK).select(*columns)
    written = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(map(str, written.collect())) == sorted(map(str, batch.collect()))

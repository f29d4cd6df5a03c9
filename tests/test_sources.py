import json

import pytest

from msgtriage import schemas
from msgtriage.sources import readers, writers
from msgtriage.sources.contract import InputContractError, validate_input

HEADER = "tweet_id,author_id,inbound,text,response_tweet_id,in_response_to_tweet_id\n"


def test_raw_csv_with_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + '3,brand,False,"line one\nline ""two"", end",,1.0\n1,u,True,hello,"3,4",\n2,u,True,x,,\n')
    rows = {r["tweet_id"]: r for r in readers.read_raw_messages(spark, str(path)).collect()}
    assert rows[3]["text"] == 'line one\nline "two", end'
    assert rows[1]["response_tweet_id"] == "3,4" and rows[1]["in_response_to_tweet_id"] is None
    assert rows[3]["in_response_to_tweet_id"] == 1 and rows[3]["inbound"] is False
    capped = readers.read_raw_messages(spark, str(path), max_rows=2).collect()
    assert sorted(r["tweet_id"] for r in capped) == [1, 2]


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_pairs_round_trip(spark, tmp_path, fmt):
    rows = [(1, 2, 'a "quoted", text\nwith a break', "reply"), (3, 4, None, "reply")]
    df = spark.createDataFrame(rows, schemas.PAIRS)
    writers.write_table(df, str(tmp_path / "p"), fmt)
    got = readers.read_pairs(spark, str(tmp_path / "p"), fmt).collect()
    assert [tuple(r) for r in got] == rows[:1]


def test_evaluation_items_from_a_json_array(spark, tmp_path):
    item = {"id": 1, "customer_text": "t", "intent": "x", "should_escalate": True, "escalation_reason": "r",
            "difficulty_stratum": "s", "reference_resolution": "ref"}
    (tmp_path / "items.json").write_text(json.dumps([item, {**item, "id": 2}], indent=2))
    df = readers.read_evaluation_items(spark, str(tmp_path / "items.json"))
    assert [r["id"] for r in df.orderBy("id").collect()] == [1, 2] and df.schema == schemas.EVALUATION_ITEMS


def test_calibration_to_long_form(spark, tmp_path):
    scores = {"groundedness": 5, "actionability": 4, "brand_tone": 3}
    record = {"id": 7, "customer_text": "t", "drafted_reply": "d", "human_scores": scores,
              "judge_scores": {**scores, "groundedness": 4}, "human_notes": "", "judge_reasoning": ""}
    (tmp_path / "c.json").write_text(json.dumps([record]))
    got = sorted(map(tuple, readers.read_calibration(spark, str(tmp_path / "c.json")).collect()))
    assert got == [(7, "actionability", 4, 4), (7, "brand_tone", 3, 3), (7, "groundedness", 5, 4)]


def test_summary_leaves_out_the_detail_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", "g", "m", None, 1.0, "big")], "system string, metric_group string, metric string, label string, value double, detailed_predictions string")
    writers.write_summary(df, str(tmp_path / "s"))
    back = readers.read_metrics(spark, str(tmp_path / "s"), "json")
    assert back.columns == schemas.METRICS.names and back.first()["value"] == 1.0


def test_missing_input_names_the_step(spark, tmp_path):
    with pytest.raises(InputContractError, match="pair extraction"):
        readers.read_pairs(spark, str(tmp_path / "nowhere"))


def test_contract(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert validate_input(df, ["id"], "a step") is df
    with pytest.raises(InputContractError, match="text"):
        validate_input(df, ["text"], "a step")
    with pytest.raises(InputContractError, match="no rows"):
        validate_input(df.limit(0), ["id"], "a step")


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), str(tmp_path / "x"), "xml")

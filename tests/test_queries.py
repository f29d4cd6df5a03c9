"""Every registered query against its SQL equivalent, on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
import compare

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    return compare.open_tables(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not re.match(r"op\d+_|pipeline$", n)))
def test_query_equals_sql(spark, tables, name):
    assert compare.differences(entry.queries()[name](spark, SF), tables, ORACLES[name]) == []


def test_trained_classifier(spark):
    rows = entry.queries()["predict_intent"](spark, SF).collect()
    assert rows and all(0 < r["confidence"] <= 1 for r in rows)
    assert entry.queries()["train_intent_model"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["simple_triage_fitted", "production_triage_fitted"])
def test_triage_with_a_fitted_model(spark, name):
    """One answer a document, and the plain label of the fitted model wherever no rule overrides it."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["id"]: r for r in entry.queries()[name](spark, SF).collect()}
    assert set(rows) == {r["doc_id"] for r in documents.collect()}
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    told = [i for i, r in rows.items() if r["intent"] in set(langs.values())]
    assert len(told) > len(rows) / 2
    assert sum(rows[i]["intent"] == langs[i] for i in told) > 0.8 * len(told)


def test_every_query_has_sql_or_a_test_of_its_own():
    own = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}  # those have tests of their own
    assert own - set(ORACLES) == {
        "train_intent_model", "predict_intent", "simple_triage_fitted", "production_triage_fitted"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0

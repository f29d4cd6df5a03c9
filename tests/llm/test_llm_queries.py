"""The registered queries, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import compare
from msgtriage.llm import queries

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert compare.differences(entry.queries()[name](spark, SF), compare.open_tables(SF), queries.ORACLES[name]) == []


def test_one_row_per_document(spark):
    documents = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for name in ("op3_token_counts", "op7_byte_bpe", "op9_dart_minhash", "op11_periodic_runs", "op13_piece_bpe"):
        rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
        assert len(rows) == len(documents) and {r["doc_id"] for r in rows} == documents


def test_hostile_conversation(spark):
    import hashlib

    said = queries.HOSTILE_TURN
    row = queries.op10_chat_format(spark, SF).where("conv_id = -1").first()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()

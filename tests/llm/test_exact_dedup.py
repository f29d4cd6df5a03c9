import hashlib
from collections import defaultdict

import pytest

from data import ENGLISH, documents, hard_documents, with_clashes
from msgtriage.llm.exact_dedup import drop_exact_copies, exact_groups


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, keep=max):
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append(i)
    out = []
    for i, text in rows:
        known = [x for x in groups[normal(text)] if x is not None]
        out.append((i, keep(known) if known else None, len(groups[normal(text)]),
                    hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    rows = exact_groups(df, **more).collect()
    return rows, sorted(((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in rows), key=str)


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_groups_equal_brute_force(spark, keep, best):
    df = hard_documents(spark).repartition(5)
    rows, got = found(df, keep=keep)
    assert got == expected([(r["doc_id"], r["text"]) for r in df.collect()], best)
    kept = defaultdict(int)
    for r in rows:
        kept[bytes(r["digest"])] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("fan_in", [2, 4])
def test_many_rounds_and_a_hot_group(spark, fan_in):
    rows = [(i, ENGLISH.upper() if i % 3 == 0 else f"text {i % 40}") for i in range(300)]
    df = documents(spark, rows).repartition(13)
    assert found(df, keep="largest", fan_in=fan_in)[1] == expected(rows)


def test_only_ascii_is_lowered(spark):
    rows = [(1, "É"), (2, "é"), (3, "AÉ"), (4, "aÉ"), (5, "K"), (6, "k")]
    assert found(documents(spark, rows), keep="largest")[1] == expected(rows)


def test_empty_table(spark):
    assert found(documents(spark, []))[0] == []
    assert drop_exact_copies(documents(spark, [])).collect() == []


def test_clashing_columns_and_columns_kept(spark):
    df = with_clashes(documents(spark, [(1, "x"), (2, "X"), (3, "y")]), "digest", "run", "tag", "id", "kept", "n", "best")
    out = drop_exact_copies(df, keep="largest")
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_arguments(spark):
    with pytest.raises(ValueError):
        exact_groups(documents(spark, []), keep="first")
    with pytest.raises(ValueError):
        exact_groups(documents(spark, []), fan_in=3)


def test_no_python_in_the_plan(spark):
    plan = exact_groups(documents(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import with_clashes
from msgtriage.llm import collision_search as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, asks, k=5):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in usable:
        if asks(q):
            for query in usable[q][:1]:
                scores = [(-(v * query).sum() / (np.sqrt((v * v).sum()) * np.sqrt((query * query).sum())), i)
                          for i, vs in usable.items() if i != q for v in vs if len(v) == len(query)]
                out[q] = sorted(scores)[:k]
    return out


def search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return C.nearest(with_clashes(df, "block", "id", "vector"), F.col("vec_id") % 50 == 0, **more).collect()


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q, best in want.items():
        mine = sorted(found.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert sorted(mine, key=lambda m: (-m[2], m[1])) == mine
        total += len(best)
        hit += len({m[1] for m in mine} & {i for _, i in best})
    assert set(found) == set(want)
    return hit / max(1, total)


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall_over_blocks(spark, clusters, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 700)
    monkeypatch.setattr(C, "QUERIES", 20)
    rng = np.random.default_rng(2)
    points = rng.standard_normal((2000, 32))
    if clusters:
        points = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 2000)] + 0.3 * points
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    got = search(spark, rows)
    assert recall(got, brute_force(rows, lambda i: i % 50 == 0)) >= 0.9


def test_ties_go_by_id(spark):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(0, 300, 2)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 300, 2)]
    got = [r for r in search(spark, rows) if r["query_id"] == 100]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 2, 4, 6, 8]
    assert len({r["score"] for r in got}) == 1


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (50, [0.0, 0.0]), (100, None), (7, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
            (7, [1.0, 1.0]), (150, [0.0, 2.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in search(spark, rows)]
    assert sorted(got) == [(0, 1, 7), (0, 2, 7), (0, 3, 8), (150, 1, 9)]


def test_empty(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(1, [1.0]), (2, [2.0])]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_table(spark, sf):
    from pathlib import Path

    from msgtriage.llm import queries

    folder = Path("/root/testdata") / sf
    if not folder.is_dir():
        pytest.skip("test tables are not here")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(queries.op5_collision_search(spark, str(folder)).collect(), brute_force(rows, lambda i: i % 50 == 0)) >= 0.9


def test_sizes_of_vectors_do_not_matter(spark):
    rng = np.random.default_rng(7)
    points = rng.standard_normal((60, 8))
    sizes = [1e-200, 1.0, 1e200] * 20
    doubles = "vec_id long, embedding array<double>"
    plain, scaled = (
        C.nearest(spark.createDataFrame([(i, (p * s).tolist()) for i, (p, s) in enumerate(zip(points, many))], doubles),
                  F.col("vec_id") % 50 == 0).collect() for many in ([1.0] * 60, sizes))
    key = lambda r: (r["query_id"], r["rank"])
    for a, b in zip(sorted(plain, key=key), sorted(scaled, key=key), strict=True):
        assert a["vec_id"] == b["vec_id"] and a["score"] == pytest.approx(b["score"], abs=1e-12)

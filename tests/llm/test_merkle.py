"""The manifest against a tree built in plain Python."""

import hashlib
import random
from zlib import crc32

from compare import plan_of
from data import DOCUMENTS, HARD_TEXTS
from pyspark.sql import functions as F

from msgtriage.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(digests):
    """The last digest, and for each leaf the (left, right) siblings, bottom up."""
    paths, owner, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for leaf, at in enumerate(owner):
            first = at // 16 * 16
            paths[leaf].append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 16])))
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        owner = [at // 16 for at in owner]
    return nodes[0], paths


def leaf_of(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row, leaf_of(row, row[1])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = climb([leaf for _, leaf in groups[g]])
    root, crown = climb([trees[g][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for (row, leaf), path in zip(groups[g], trees[g][1]):
            whole = path + crown[place]
            folded = leaf
            if row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                folded = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]))
            for left, right in whole:
                folded = sha(left, folded, right)
            out.append((str(row[0]), leaf, trees[g][0], root, sha(*[x + y for x, y in whole]), folded, folded == root))
    return sorted(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(spark, rows, path):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(path)).collect()
    return sorted((str(r["doc_id"]), *[r[c] for c in NAMES[1:]]) for r in got)


def test_groups_of_all_sizes(spark, tmp_path):
    """A hot source of more than 16 * 16 leaves, lone leaves, sizes about powers of 16; null and empty sources."""
    rng = random.Random(12)
    sizes = {"hot": 700, None: 17, "": 16, "one": 1, "é": 15, "z": 257, "Z": 256, **{f"s{i}": i % 3 + 1 for i in range(30)}}
    rows = []
    for source, size in sizes.items():
        for _ in range(size):
            text = rng.choice([*HARD_TEXTS, "Some TEXT", "some text"])
            rows.append((len(rows) * 7 % 100_003, text, rng.choice(["en", None, ""]), source, rng.choice([None, 5])))
    rng.shuffle(rows)
    assert found(spark, rows, tmp_path) == expected(rows)


def test_ties_nulls_and_repeats(spark, tmp_path):
    rows = [(1, "a", "en", "s", 1)] * 40 + [(1, "b", None, "s", 1), (None, "c", "en", "s", None), (None, "C", "en", "s", None)]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_one_row_and_none(spark, tmp_path):
    rows = [(5, "Text", "en", "s", 4)]
    got = found(spark, rows, tmp_path / "one")
    assert got == expected(rows) and got[0][1] == got[0][2] == got[0][3]
    assert got[0][4] == sha() and not [r for r in got if r[6] != (r[5] == r[3])]
    assert found(spark, [], tmp_path / "none") == []


def test_clashing_columns(spark):
    names = ("group", "order", "digest", "path", "lo", "hi", "size", "rank", "members", "tag", "carried", "root")
    df = spark.range(40).select("id", *[F.lit("clash").alias(n) for n in names])
    out = merkle.manifest(df, F.col("group"), F.col("id"), merkle.leaf_digest(F.col("id"), F.col("path")), {"lo": F.col("id")})
    rows = out.select("carried.lo", (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert sorted(r["lo"] for r in rows) == list(range(40)) and all(r["ok"] for r in rows)


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(40)], DOCUMENTS).write.parquet(
        f"{tmp_path}/documents.parquet")
    plan = plan_of(queries.op12_merkle_manifest(spark, str(tmp_path)))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))

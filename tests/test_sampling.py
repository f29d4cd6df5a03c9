import random
from collections import Counter

from compare import plan_of
from msgtriage.operators import limits, sampling
from msgtriage.packs import support
from msgtriage.plans.dataprep import build_evaluation_set

rng = random.Random(1)
ROWS = [(i, rng.choice("aaaabbc")) for i in range(300)]
QUOTAS = {"a": 10, "b": 7}


def walk(rows, seeds, quotas, default, size):
    """The definition: accept in order while the class has room and the set is not full."""
    counts, kept = Counter(seeds), []
    for i, label in rows:
        if counts[label] < quotas.get(label, default):
            kept.append(i)
            counts[label] += 1
        if len(kept) + len(seeds) >= size:
            break
    return kept


def test_quota_sample_equals_the_walk(spark):
    df = spark.createDataFrame(ROWS, "key long, intent string").repartition(5)
    for seeds in (None, ["a"] * 4 + ["b"] * 9):
        table = None if seeds is None else spark.createDataFrame([(s,) for s in seeds], "intent string")
        for size in (15, 200):
            got = sampling.quota_sample(df, table, QUOTAS, "key", size, default_quota=3).orderBy("id").collect()
            assert [r["key"] for r in got] == walk(ROWS, seeds or [], QUOTAS, 3, size)
            first = 1 + len(seeds or [])
            assert [r["id"] for r in got] == list(range(first, first + len(got)))


def test_quota_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame(ROWS, "key long, intent string")
    plan = plan_of(sampling.quota_sample(df, None, QUOTAS, "key"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_topup(spark):
    items = spark.createDataFrame([(1, "t", "x"), (2, "u", "y")], "id long, customer_text string, intent string")
    filled = sampling.topup_fill(items, 7, "filler 11.0.%d", 4, {"intent": "z"}).orderBy("id").collect()
    assert [r["id"] for r in filled] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["customer_text"] for r in filled[2:]] == [f"filler 11.0.{i % 4}" for i in range(2, 7)]
    assert sampling.topup_fill(items, 1, "x%d", 4, {"intent": "z"}).count() == 2


def test_topup_ids_are_new(spark):
    items = spark.createDataFrame([(4, "t", "x"), (9, "u", "y")], "id long, customer_text string, intent string")
    filled = sampling.topup_fill(items, 5, "filler %d", 4, {"intent": "z"}).orderBy("id").collect()
    assert [r["id"] for r in filled] == [4, 9, 10, 11, 12]
    assert [r["customer_text"] for r in filled[2:]] == ["filler 2", "filler 3", "filler 0"]


def test_breakdown_in_one_pass(spark):
    df = spark.createDataFrame([("a", True), ("a", False), (None, True)], "intent string, should_escalate boolean")
    got = {(r["facet"], r["value"]): r["n"] for r in sampling.breakdown_counts(df, ["intent", "should_escalate"]).collect()}
    assert got == {("intent", "a"): 2, ("intent", None): 1, ("should_escalate", "true"): 2, ("should_escalate", "false"): 1}


def test_evaluation_set(spark):
    rows = [(i, i, f"my battery is at {i} percent again", "reply  one") for i in range(60)]
    rows += [(100 + i, 100 + i, f"i forgot my password number {i}", "reply ’s") for i in range(40)]
    rows += [(200, 200, "battery", "too short"), (201, 201, "no keyword in this one at all", "r")]
    corpus = spark.createDataFrame(rows, "inquiry_id long, response_id long, customer_text string, agent_text string")
    built = build_evaluation_set(
        corpus, None, support.EVALUATION_LEXICON, support.STRATUM_RULES, support.STRATUM_DEFAULT,
        support.QUOTAS, support.DEFAULT_QUOTA).orderBy("id").collect()
    counts = Counter(r["intent"] for r in built)
    assert counts == {support.BATTERY: 32, support.ACCOUNT: 26}
    assert [r["id"] for r in built] == list(range(1, 59))
    assert built[0]["reference_resolution"] == "reply one" and built[-1]["reference_resolution"] == "reply 's"
    assert {r["difficulty_stratum"] for r in built} == {"routine_clear", "pii_account_lock"}


def test_number_all_needs_no_single_task(spark):
    keys = rng.sample(range(10**6), 500)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "key long, text string").repartition(5)
    numbered = limits.number_all(df, "key")
    got = sorted((r["id"], r["key"], r["text"]) for r in numbered.collect())
    assert got == [(i, k, str(k)) for i, k in enumerate(sorted(keys), 1)]
    assert numbered.columns == ["key", "text", "id"]
    assert limits.number_all(df.limit(0), "key").collect() == []

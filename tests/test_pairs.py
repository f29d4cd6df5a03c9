from pyspark.sql import functions as F

from compare import plan_of
from msgtriage import schemas
from msgtriage.operators import limits, pairs

LONG = "long enough customer text"
REPLY = "a long enough reply text"


def raw(spark, rows):
    full = [(i, a, inb, t, None, p) for i, a, inb, t, p in rows]
    return spark.createDataFrame(full, schemas.RAW_MESSAGES)


ROWS = [
    (1, "u1", True, f"@Brand {LONG}", None),
    (2, "brand", False, REPLY, 1),
    (3, "u2", True, f"no mention, {LONG}", None),
    (4, "brand", False, REPLY, 3),            # parent does not mention the handle
    (5, "u3", True, "@brand hi", None),
    (6, "brand", False, REPLY, 5),            # message too short
    (7, "brand", False, "short", 1),          # reply too short
    (8, "brand", False, REPLY, None),         # no parent
    (9, "brand", False, REPLY, 2),            # parent not inbound
    (10, "u4", True, f"@BRAND  {LONG}", None),
    (11, "brand", False, REPLY + " b", 10),
    (12, "brand", False, REPLY + " a", 1),    # a second reply to message 1
    (13, "u5", True, None, None),
    (14, "brand", True, REPLY, 1),            # inbound, though by the brand
    (15, "u6", True, f"@Brand   {LONG}", None),
    (16, "brand", False, REPLY + " c", 15),   # same text as message 1 once cleaned
]


def ids(df):
    return sorted((r["inquiry_id"], r["response_id"]) for r in df.collect())


def test_reply_pairs(spark):
    assert ids(pairs.reply_pairs(raw(spark, ROWS), "brand", "@brand")) == [(1, 2), (1, 12), (10, 11), (15, 16)]
    assert (3, 4) in ids(pairs.reply_pairs(raw(spark, ROWS), "brand"))


def test_repeated_ids_make_one_pair(spark):
    rows = [(1, "u", True, f"{LONG} b", None), (1, "u", True, f"{LONG} a", None), (2, "brand", False, REPLY, 1),
            (2, "brand", False, REPLY, 1), (3, "brand", False, REPLY, 1)]
    got = sorted(map(tuple, pairs.reply_pairs(raw(spark, rows), "brand").collect()))
    assert got == [(1, 2, f"{LONG} a", REPLY), (1, 3, f"{LONG} a", REPLY)]


def test_no_cap_unless_given(spark):
    messages = raw(spark, ROWS)
    assert ids(pairs.capped_pairs(messages, "brand")) == ids(pairs.build_corpus(messages, "brand"))


def test_cap_comes_before_dedup(spark):
    capped = pairs.capped_pairs(raw(spark, ROWS), "brand", "@brand", max_pairs=3)
    assert ids(capped) == [(1, 2), (10, 11)]


def test_corpus_equals_pairs_then_dedup(spark):
    messages = raw(spark, ROWS)
    expected = pairs.dedup_keep_first(pairs.reply_pairs(messages, "brand"), "customer_text", "response_id")
    assert sorted(map(tuple, pairs.build_corpus(messages, "brand").collect())) == sorted(
        map(tuple, expected.collect()))


def test_one_message_with_a_third_of_the_replies(spark):
    """The corpus reduces replies per message before its join."""
    rows = [(1, "u", True, LONG, None)] + [(i, "brand", False, REPLY, 1) for i in range(2, 500)]
    rows += [(i, "u", True, f"{LONG} {i}", None) for i in range(500, 1000)]
    rows += [(i + 1000, "brand", False, REPLY, i) for i in range(500, 1000)]
    corpus = pairs.build_corpus(raw(spark, rows), "brand")
    assert corpus.count() == 501
    assert corpus.where("inquiry_id = 1").first()["response_id"] == 2


def test_dedup_keeps_lowest_key_and_all_columns(spark):
    df = spark.createDataFrame([(3, "x", "c"), (1, "x", "a"), (2, "y", None)], "id int, t string, o string")
    got = sorted(map(tuple, pairs.dedup_keep_first(df, "t", "id").collect()))
    assert got == [(1, "x", "a"), (2, "y", None)]


def test_leakage_with_every_salt(spark):
    hot = [(i, " same text ") for i in range(300)] + [(i, f"t{i}") for i in range(300, 310)]
    corpus = spark.createDataFrame(hot, "id int, customer_text string")
    gold = spark.createDataFrame([("same text",), ("t300",), ("same text",)], "customer_text string")
    kept = pairs.drop_leaked(corpus, gold, "id")
    assert sorted(r["id"] for r in kept.collect()) == list(range(301, 310))
    assert kept.columns == corpus.columns
    assert pairs.find_leaked(corpus, gold).count() == 301


def test_leakage_in_spite_of_any_whitespace(spark):
    texts = ["my phone is dead\n", "\u00a0my phone is dead", "\tmy phone is dead ", "my phone is dead!", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, customer_text string")
    gold = spark.createDataFrame([("my phone is dead",)], "customer_text string")
    assert sorted(r["id"] for r in pairs.drop_leaked(corpus, gold, "id").collect()) == [3, 4]
    assert sorted(r["id"] for r in pairs.find_leaked(corpus, gold).collect()) == [0, 1, 2]


def test_first_n_is_exact_and_not_sorted_as_a_whole(spark):
    df = spark.range(0, 1000, 1, 8).select((F.lit(999) - F.col("id")).alias("k"), F.lit("x").alias("payload"))
    got = limits.first_n(df, "k", 10)
    assert sorted(r["k"] for r in got.collect()) == list(range(10))
    assert limits.first_n(df, "k", 5000).count() == 1000


def test_first_n_by_counting_ranges(spark, monkeypatch):
    """So many keys that their ranges are counted more than once."""
    monkeypatch.setattr(limits, "FEW_KEYS", 20)
    df = spark.range(0, 3000, 1, 6).select((F.col("id") * 7 % 3001).alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    keys = sorted(i * 7 % 3001 for i in range(3000))
    for n in (0, 1, 19, 700, 2999, 3000, 9000):
        assert sorted(r["k"] for r in limits.first_n(df, "k", n).collect()) == keys[:n]
    names = sorted(f"n{i}" for i in range(3000))
    assert sorted(r["name"] for r in limits.first_n(df, "name", 1234).collect()) == names[:1234]
    assert limits.first_n(df.where("false"), "k", 5).count() == 0
    same = spark.range(100).select(F.lit(1).alias("k"))
    assert limits.first_n(same, "k", 30).count() == 100


def test_capped_pairs_pair_once(spark, tmp_path):
    """The cut is found in what was stored: the plan of the result has no join."""
    raw(spark, ROWS).write.parquet(str(tmp_path / "m"))
    plan = plan_of(pairs.capped_pairs(spark.read.parquet(str(tmp_path / "m")), "brand", max_pairs=2))
    assert "Join" not in plan and "TakeOrdered" not in plan


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    assert [tuple(r) for r in limits.duplicate_keys(df, "k").collect()] == [(1, 2)]


def test_filters_reach_the_scan(spark, tmp_path):
    raw(spark, ROWS).write.parquet(str(tmp_path / "m"))
    plan = plan_of(pairs.reply_pairs(spark.read.parquet(str(tmp_path / "m")), "brand"))
    assert "EqualTo(inbound,true)" in plan and "EqualTo(author_id,brand)" in plan
    assert "ReadSchema: struct<tweet_id:bigint,inbound:boolean,text:string>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_leakage_join_moves_digests_of_evaluation_texts(spark):
    """Whole texts are not repeated per salt."""
    corpus = spark.createDataFrame([(1, " seen\n"), (2, "new"), (3, None)], "id long, customer_text string")
    seen = spark.createDataFrame([("seen",), ("seen ",)], "customer_text string")
    kept = pairs.drop_leaked(corpus, seen, "id")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert "sha2" in plan_of(kept)

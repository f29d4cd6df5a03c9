import glob
import math
import random
import re
import time
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import Window, functions as F

from compare import plan_of
from msgtriage.operators import retrieval
from msgtriage.operators.retrieval import CaseIndex, rank_cases, retrieve
from msgtriage.operators.tfidf import TfidfConfig, TfidfModel, retriever_config, vocabulary

rng = random.Random(3)
WORDS = ["hot"] * 30 + [f"w{i}" for i in range(40)]
CORPUS = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))), f"answer {i}") for i in range(60)]
CORPUS += [(100, CORPUS[5][1], "copy of 5"), (101, CORPUS[5][1], "copy of 5")]
QUERIES = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(25)]
QUERIES += [(50, "nothing shared"), (51, ""), (52, None), (53, CORPUS[5][1])]
CONFIG = TfidfConfig(1, 2, 120, sublinear=True, stop_words=("w3",))


def terms(text, config):
    tokens = [t for t in re.findall(r"\b\w\w+\b", (text or "").lower()) if t not in config.stop_words]
    return [" ".join(tokens[i:i + n]) for n in range(config.low, config.high + 1) for i in range(len(tokens) - n + 1)]


def brute_model(texts, config):
    docs = [terms(t, config) for t in texts]
    cf, df = Counter(w for d in docs for w in d), Counter(w for d in docs for w in set(d))
    kept = sorted(cf, key=lambda w: (-cf[w], w))[:config.max_features]
    return {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in kept}


def brute_vector(text, idf, config):
    tf = Counter(w for w in terms(text, config) if w in idf)
    raw = {w: ((1 + math.log(c)) if config.sublinear else c) * idf[w] for w, c in tf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {w: x / norm for w, x in raw.items()}


WHOLE = replace(CONFIG, max_features=None)


def brute_top(k, config=CONFIG, corpus=CORPUS, queries=QUERIES):
    idf = brute_model([t for _, t, _ in corpus], config)
    cases = {i: brute_vector(t, idf, config) for i, t, _ in corpus}
    out = {}
    for q, text in queries:
        v = brute_vector(text, idf, config)
        scored = [(round(sum(x * c.get(w, 0) for w, x in v.items()), 6), i) for i, c in cases.items()]
        out[q] = sorted(((s, i) for s, i in scored if s > 0), key=lambda p: (-p[0], p[1]))[:k]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "inquiry_id long, customer_text string, agent_text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "id long, customer_text string").repartition(3)


@pytest.fixture(scope="module")
def index(corpus):
    return CaseIndex.build(corpus, CONFIG)


@pytest.fixture(scope="module")
def whole_index(corpus):
    """With every term."""
    return CaseIndex.build(corpus, WHOLE)


def found(ranked):
    out = {q: [] for q, _ in QUERIES}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        out[r["id"]].append((r["score"], r["doc_id"]))
    return out


def assert_same(got, expected):
    for q in expected:
        assert [i for _, i in got[q]] == [i for _, i in expected[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]], abs=1.1e-6)


def test_vocabulary_and_weights_by_brute_force(spark, corpus):
    for config in (CONFIG, TfidfConfig(1, 3, 50), TfidfConfig(1, 1, 5)):
        idf = brute_model([t for _, t, _ in CORPUS], config)
        rows = vocabulary(corpus, "customer_text", config).collect()
        assert [r["term"] for r in rows] == list(idf)
        model = TfidfModel.fit(corpus, "customer_text", config)
        got = {(r["inquiry_id"], r["term"]): r["weight"] for r in model.weights(corpus, "inquiry_id", "customer_text").collect()}
        expected = {(i, w): x for i, t, _ in CORPUS for w, x in brute_vector(t, idf, config).items()}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_best_cases_by_brute_force(index, whole_index, queries):
    for k in (1, 3, 70):
        assert_same(found(rank_cases(queries, index, k)), brute_top(k))
        assert_same(found(rank_cases(queries, whole_index, k)), brute_top(k, WHOLE))


@pytest.mark.parametrize("settings", [
    {"FIRST": 1}, {"SCORED_FIRST": 1}, {"REST": 0.9}, {"REST": 0.0}, {"CLASS_BASE": 1.05, "LEVEL_STEP": 0.1},
    {"CLASS_BASE": 50.0, "LEVEL_STEP": 9.0}, {"PART": 7}, {"WHOLE": 60}, {"WHOLE": 1_000_000},
])
def test_no_setting_changes_the_result(spark, queries, monkeypatch, settings):
    """Repeated words, short and long cases, and terms that are dealt to parts; bounds are sought if not said otherwise."""
    for name, value in {"WHOLE": 0, **settings}.items():
        monkeypatch.setattr(retrieval, name, value)
    long_cases = [(1000 + i, " ".join(["hot"] * i + [f"w{j % 40}" for j in range(i, 9 * i)]), "x") for i in range(1, 40)]
    index = CaseIndex.build(
        spark.createDataFrame(CORPUS + long_cases, "inquiry_id long, customer_text string, agent_text string"), WHOLE)
    assert_same(found(rank_cases(queries, index, 3)), brute_top(3, WHOLE, CORPUS + long_cases))


@pytest.mark.parametrize("read_whole", [0, 1_000_000])
def test_long_messages_against_short_cases_and_the_reverse(spark, monkeypatch, read_whole):
    """A pair is scored from its shorter side, whichever that is."""
    monkeypatch.setattr(retrieval, "WHOLE", read_whole)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, k=3 if i % 2 else 150))) for i in range(40)]
    config = TfidfConfig(1, 1, sublinear=True)
    index = CaseIndex.build(spark.createDataFrame(
        [(i, t, "x") for i, t in texts], "inquiry_id long, customer_text string, agent_text string"), config)
    asked = spark.createDataFrame(texts, "id long, customer_text string")
    vector = {}
    for r in index.weights.collect():
        vector.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    # The messages are the cases, so their weights are those of the index.
    for r in rank_cases(asked, index, 40).collect():
        q, d = vector[r["id"]], vector[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(w * d.get(t, 0.0) for t, w in q.items()), abs=1.1e-6)
    best = {r["id"]: r["doc_id"] for r in rank_cases(asked, index, 1).collect()}
    assert len(best) == 40 and all(best[i] == i for i, _ in texts if i % 2 == 0)


def test_bounds_spare_most_pairs(spark, monkeypatch):
    """Cases of one topic each: a message is scored against few cases of other topics."""
    topics = [[f"t{i}x{j}" for j in range(12)] for i in range(25)]
    common = [f"c{j}" for j in range(30)]

    def text(topic, rng=random.Random(5)):
        return " ".join(rng.choice(topic) if rng.random() < 0.5 else rng.choice(common) for _ in range(40))

    cases = [(i, text(topics[i % 25]), "x") for i in range(1000)]
    asked = [(i, text(topics[i])) for i in range(25)]
    index = CaseIndex.build(spark.createDataFrame(cases, "inquiry_id long, customer_text string, agent_text string"),
                            TfidfConfig(1, 1, sublinear=True))
    queries = spark.createDataFrame(asked, "id long, customer_text string")
    monkeypatch.setattr(retrieval, "WHOLE", 0)
    assert retrieval.scores(queries, index).count() > 20_000
    assert retrieval.candidates(queries, index, 3).count() < 2_000
    got = sorted((r["id"], r["score"]) for r in rank_cases(queries, index, 3).collect())
    by_score = Window.partitionBy("id").orderBy(F.desc("score"))
    every = retrieval.scores(queries, index).withColumn("n", F.row_number().over(by_score)).where("n <= 3")
    assert got == sorted((r["id"], r["score"]) for r in every.collect())


def test_scores_of_all_pairs(index, queries):
    got = {(r["id"], r["doc_id"]): r["score"] for r in retrieval.scores(queries, index).collect()}
    want = {(q, i): s for q, best in brute_top(1000).items() for s, i in best}
    assert {p: s for p, s in got.items() if s > 0} == pytest.approx(want, abs=1.1e-6)


def test_index_grown_in_steps_equals_one_built_at_once(spark, corpus, queries, tmp_path):
    whole = CaseIndex.build(corpus, WHOLE, path=str(tmp_path / "whole"))
    grown = CaseIndex.build(corpus.where("inquiry_id < 20"), WHOLE, path=str(tmp_path / "grown"))
    first = sorted(map(str, rank_cases(queries, grown, 3).collect()))
    second = grown.extend(corpus.where("inquiry_id between 20 and 50")).extend(corpus.where("inquiry_id > 50"))
    rows = lambda i: sorted((r["doc_id"], r["term"], round(r["weight"], 12)) for r in i.postings.collect())
    assert rows(second) == rows(whole) and second.n_docs == whole.n_docs
    assert_same(found(rank_cases(queries, second, 3)), brute_top(3, WHOLE))
    assert sorted(map(str, rank_cases(queries, grown, 3).collect())) == first
    again = CaseIndex.load(spark, str(tmp_path / "grown"))
    assert again.version == 2 and rows(again) == rows(whole)


def test_retrieve_keeps_messages_without_a_match(index, queries):
    rows = {r["id"]: r for r in retrieve(queries, index, 2).collect()}
    assert len(rows) == len(QUERIES)
    for q in (50, 51, 52):
        assert rows[q]["retrieved"] == [] and rows[q]["retrieval_score"] == 0.0
    best = rows[53]["retrieved"]
    assert [c["doc_id"] for c in best] == [5, 100] and best[0]["historical_resolution"] == "answer 5"
    assert rows[53]["retrieval_score"] == 1.0


def exchanged_scans(plan):
    """The tables that are read right below an exchange."""
    lines = [re.sub(r"^[\s:+*|-]*(\(\d+\) )?", "", line) for line in plan.splitlines()]
    out, below = [], None
    for line in lines:
        if line.startswith("Exchange"):
            below = True
        elif line.startswith(("FileScan", "Scan")):
            if below:
                out.append(line)
            below = None
        elif not line.startswith(("Filter", "Project", "ColumnarToRow", "Sort", "WholeStageCodegen", "InputAdapter")):
            below = None
    return out


def test_the_index_is_read_where_it_lies(spark, whole_index, queries):
    """Without a broadcast, the postings and the weights are joined without an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(rank_cases(queries, whole_index, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Both are read for the lower bounds and for the result.
    assert plan.count("Bucketed: true") == 4 and "CartesianProduct" not in plan
    assert not [scan for scan in exchanged_scans(plan) if "Bucketed: true" in scan]


def test_a_message_without_an_id_is_an_error(spark, index):
    df = spark.createDataFrame([(None, "w1 w2")], "id long, customer_text string")
    with pytest.raises(Exception, match="a row has no id"):
        retrieve(df, index, 1).collect()


def test_stored_index_gives_the_same_answers(spark, corpus, queries, tmp_path):
    stored = CaseIndex.build(corpus, CONFIG, path=str(tmp_path / "index"))
    again = CaseIndex.load(spark, str(tmp_path / "index"))
    assert again.config == stored.config and again.n_docs == stored.n_docs
    assert again.postings.count() == stored.postings.count()
    assert_same(found(rank_cases(queries, again, 3)), brute_top(3))


def test_rows_without_texts_are_not_indexed(spark):
    df = spark.createDataFrame(
        [(1, "aa bb", None), (2, None, "x"), (3, "aa cc", "x")],
        "inquiry_id long, customer_text string, agent_text string")
    index = CaseIndex.build(df, CONFIG)
    assert index.n_docs == 1 and index.weights.select("doc_id").distinct().count() == 1


def test_empty_corpus(spark, queries):
    df = spark.createDataFrame([], "inquiry_id long, customer_text string, agent_text string")
    rows = retrieve(queries, CaseIndex.build(df, CONFIG), 3).collect()
    assert len(rows) == len(QUERIES) and all(r["retrieved"] == [] for r in rows)


def test_default_stop_words_come_from_spark(spark):
    assert "the" in retriever_config().stop_words


def test_most_frequent_terms_cut_within_equal_counts(spark):
    from msgtriage.operators.tfidf import most_frequent

    rows = [(f"t{i:03d}", 1 + i % 4, 1) for i in range(200)]
    counts = spark.createDataFrame(rows, "term string, cf long, df long").repartition(5)
    for n in (1, 50, 51, 120, 199, 200, 500):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
        got = most_frequent(counts, n).collect()
        assert sorted(r["term"] for r in got) == sorted(r[0] for r in want)


def test_sums_of_pairs_stay_in_their_task(spark, whole_index, queries):
    """What moves grows with the messages and the cases, not with their pairs."""
    for found_pairs in (rank_cases(queries, whole_index, 3), retrieval.scores(queries, whole_index)):
        plan = plan_of(found_pairs)
        assert "CartesianProduct" not in plan and not re.search(r"hashpartitioning\(_q#\w+, doc_id#", plan)


def test_groups_and_blocks_change_nothing(whole_index, queries, monkeypatch):
    monkeypatch.setattr(retrieval, "ENTRIES", 300)
    monkeypatch.setattr(retrieval, "AT_ONCE", 100)
    monkeypatch.setattr(retrieval, "PAIRS", 400)
    for k in (1, 70):
        assert_same(found(rank_cases(queries, whole_index, k)), brute_top(k, WHOLE))
    got = {(r["id"], r["doc_id"]): r["score"] for r in retrieval.scores(queries, whole_index).collect()}
    want = {(q, i): s for q, best in brute_top(1000, WHOLE).items() for s, i in best}
    assert {p: s for p, s in got.items() if s > 0} == pytest.approx(want, abs=1.1e-6)


def test_long_terms_with_rare_parts_are_not_counted(spark):
    """The vocabulary is the same as if all terms were; terms whose parts cannot be in it need no count."""
    from msgtriage.operators.tfidf import frequent_counts, most_frequent, term_counts

    draw = random.Random(1)
    words = [f"w{int(draw.paretovariate(0.6)) % 60}-x" for _ in range(2000)]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(texts, "id long, text string")
    every = term_counts(df, "text", TfidfConfig(1, 3)).count()
    for low, n in ((1, 17), (1, 200), (1, 50_000), (2, 60)):
        config = TfidfConfig(low, 3, n, stop_words=("w1",))
        want = sorted(map(tuple, most_frequent(term_counts(df, "text", config), n).collect()), key=lambda r: (-r[1], r[0]))
        assert list(map(tuple, vocabulary(df, "text", config).collect())) == want
    assert frequent_counts(df, "text", TfidfConfig(1, 3, 17)).count() < every / 10


def test_terms_are_counted_where_their_texts_are(spark, monkeypatch):
    """No row per occurrence, and the same counts however few texts are counted at a time."""
    from msgtriage.operators import tfidf

    texts = [None, "", "a", "a b", "a b a b a b", "b", "", "é a b c", "c c c c"] * 3
    tokens = spark.createDataFrame([((t or "").split(),) for t in texts], "tokens array<string>").coalesce(2)
    assert "Generate" not in plan_of(tfidf.term_counts_of(tokens, 2, None))
    for at_once in (1, 9, 8_000_000):
        monkeypatch.setattr(tfidf, "COUNTED", at_once, raising=False)
        for n in (1, 2, 3):
            cf, df = Counter(), Counter()
            for words in ((t or "").split() for t in texts):
                grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
                cf.update(grams), df.update(set(grams))
            got = {r["term"]: (r["cf"], r["df"]) for r in tfidf.term_counts_of(tokens, n, None).collect()}
            assert got == {t: (cf[t], df[t]) for t in cf}


def test_many_pairs_make_no_more_copies(spark):
    """Neither side is repeated for each few thousand rows of the other, since pairs leave a task as they are made."""
    cases = spark.range(9000).selectExpr("id inquiry_id", "concat('aa bb', id % 50) customer_text", "'x' agent_text")
    asked = spark.range(9000).selectExpr("id", "concat('aa bb', id % 50) customer_text")
    index = CaseIndex.build(cases, TfidfConfig(1, 1))
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(_cell#\w+, (\d+)\)", plan_of(retrieval.scores(asked, index)))]
    assert tasks and max(tasks) <= 2 * spark.sparkContext.defaultParallelism
    pairs = retrieval.scores(asked.where("id < 30"), index)
    assert pairs.count() == 30 * 9000 and pairs.where("doc_id = id and abs(score - 1) > 1e-6").count() == 0


def test_no_row_is_made_for_a_message_and_term(whole_index, queries, monkeypatch):
    """A message moves as its words, once: its terms are many times larger than its text."""
    def made(*_):
        raise AssertionError("a row for each message and term")

    monkeypatch.setattr(retrieval, "counts_by_row", made)
    stored = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: stored.append(name) or df)
    plan = plan_of(rank_cases(queries, whole_index, 3))
    assert not stored and not re.search(r"hashpartitioning\(term#", plan)
    assert_same(found(rank_cases(queries, whole_index, 3)), brute_top(3, WHOLE))


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 3), (3, 3)])
def test_many_groups_and_terms_of_any_length(spark, corpus, queries, monkeypatch, low, high):
    """The terms and cases pass by each group in lists and blocks; keys that repeat are one message."""
    for name, value in {"HELD": 300, "ENTRIES": 150, "TERMS_A_ROW": 7}.items():
        monkeypatch.setattr(retrieval, name, value, raising=False)
    config = replace(WHOLE, low=low, high=high)
    index = CaseIndex.build(corpus, config)
    assert_same(found(rank_cases(queries, index, 3)), brute_top(3, config))
    idf = brute_model([t for _, t, _ in CORPUS], config)
    halves = [CORPUS[7][1], CORPUS[8][1]]
    twice = spark.createDataFrame([("m", t) for t in halves] + [("n", halves[0])], "id string, customer_text string")
    tf = Counter(w for t in halves for w in terms(t, config) if w in idf)
    raw = {w: (1 + math.log(c)) * idf[w] for w, c in tf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    want = {}
    for i, t, _ in CORPUS:
        case = brute_vector(t, idf, config) if any(w in idf for w in terms(t, config)) else {}
        if any(w in case for w in raw):
            want[i] = sum(x / norm * case.get(w, 0) for w, x in raw.items())
    got = {r["doc_id"]: r["score"] for r in retrieval.scores(twice, index).where("id = 'm'").collect()}
    assert got == pytest.approx(want, abs=1.1e-6)


RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_copies_of_the_index_are_made_a_round_at_a_time(spark, whole_index, queries, monkeypatch):
    """However many groups of messages there are, no shuffle has more copies than there are cores."""
    cores, tasks, kind = spark.sparkContext.defaultParallelism, [], type(queries)
    dealt = kind.repartition

    def counted(self, n, *by):
        tasks.append((n, spark.conf.get(RELEASE_KEY, None)))
        return dealt(self, n, *by)

    monkeypatch.setattr(kind, "repartition", counted)
    monkeypatch.setattr(retrieval, "HELD", 60)
    assert_same(found(rank_cases(queries, whole_index, 3)), brute_top(3, WHOLE))
    assert len(tasks) > 1 and set(tasks) == {(cores, "true")}
    assert spark.conf.get(RELEASE_KEY, None) is None
    with pytest.raises(Exception, match="a row has no id"):
        rank_cases(spark.createDataFrame([(None, "w1 w2" * 99)], "id long, customer_text string"), whole_index, 1).collect()


def test_a_built_index_leaves_no_shuffle_files(spark, corpus):
    def files():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data"))

    before = files()
    more = spark.createDataFrame([(900, "w1 w2 w1", "answer")], corpus.schema)
    index = CaseIndex.build(corpus, WHOLE).extend(more)
    for _ in range(100):    # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and index.n_docs == len(CORPUS) + 1


@pytest.mark.parametrize("settings", [{}, {"DENSE": 2.0}, {"DENSE": 0.0}, {"ENTRIES": 300, "AT_ONCE": 200, "TRIED": 5}])
def test_cases_that_single_precision_cannot_tell_apart(spark, monkeypatch, settings):
    """Norms that differ in the sixth digit rank cases; exact copies go by their ids, however many there are."""
    for name, value in settings.items():
        monkeypatch.setattr(retrieval, name, value)
    rows = [(i, " ".join(["aa"] * 400 + ["bb"] * (400 + i % 3) + ["cc"] * (i % 2))) for i in range(90)]
    rows += [(100 + i, f"bb cc dd w{i % 5}") for i in range(60)]
    corpus = spark.createDataFrame([(i, t, "r") for i, t in rows], "inquiry_id long, customer_text string, agent_text string")
    config = TfidfConfig(1, 2, sublinear=True)
    queries = [(0, "aa bb"), (1, "bb cc"), (2, "dd"), (3, rows[4][1]), (4, "bb cc dd w3"), (5, "none")]
    ranked = rank_cases(spark.createDataFrame(queries, "id long, customer_text string"), CaseIndex.build(corpus, config), 4)
    got = {q: [] for q, _ in queries}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        got[r["id"]].append((r["score"], r["doc_id"]))
    assert_same(got, brute_top(4, config, [(i, t, "r") for i, t in rows], queries))


def test_later_blocks_hand_on_only_better_cases(spark, whole_index, queries, monkeypatch):
    """A task keeps the best scores of a message, so a block adds no case that earlier ones surpass."""
    monkeypatch.setattr(retrieval, "ENTRIES", 100)
    asked = retrieval._worded(queries, whole_index, "id", "customer_text")
    handed = retrieval._product(asked, 1, retrieval._term_lists(whole_index), whole_index, retrieval._best_of_block(1, 1_000)).collect()
    scores = {}
    for r in handed:    # in the order in which they were made
        assert r["score"] >= scores.get(r["_q"], 0)
        scores[r["_q"]] = r["score"]
    assert scores == pytest.approx({q: v[0][0] for q, v in brute_top(1, WHOLE).items() if v}, abs=1.1e-6)

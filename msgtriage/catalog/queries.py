"""Every operator as a query over the given tables.

Each query reads whole tables and whole texts. Where the library knows two
shapes of an input, the tables play these parts: ``conversations`` the raw
messages, ``documents`` the messages to triage (language as intent, source as
stratum), ``labels`` the evaluation set and its escalation flag, ``orders`` two
raters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgtriage import schemas
from msgtriage.functions import text as tx
from msgtriage.operators import (
    agreement as ag, classify, escalation, labeling, lexical, limits, metrics, pairs, replies, report,
    retrieval, rubric, sampling, tfidf,
)
from msgtriage.packs import demo
from msgtriage.plans import dataprep, evaluation, triage
from msgtriage.session import materialize, shuffles_released, work_dir
from msgtriage.sources import readers, writers
from msgtriage.sources.contract import validate_input
from msgtriage.sources.readers import drop_incomplete_pairs, spread_rows
from msgtriage.streaming import triage_stream as streaming

#: More turns than a conversation can have, so that message ids are unique.
TURNS = 1 << 32
#: Pairs that the capped query keeps; fewer than there are.
PAIR_CAP = 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- the given tables in their parts ---------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_message_columns() -> list[Column]:
    """A conversation turn as a raw message; each turn answers the one before it."""
    number = F.col("conv_id") * TURNS + F.col("turn")
    return [
        number.alias("tweet_id"),
        F.when(F.col("role") == "assistant", demo.BRAND).otherwise(
            F.concat(F.col("role"), F.col("conv_id").cast("string"))).alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.col("text"),
        F.when(F.col("turn") > 0, number - 1).alias("in_response_to_tweet_id"),
    ]


def messages(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread_rows(table(spark, sf, "conversations"), "conv_id")
    return turns.select(*raw_message_columns())


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    inbound = messages(spark, sf).where("inbound")
    return inbound.select(F.col("tweet_id").alias("id"), F.col("text").alias("customer_text"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread_rows(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("customer_text"), "lang", "source"
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("id", "customer_text")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as evaluation items."""
    flag = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("flag"))
    return docs(spark, sf).join(flag, "id").select(
        "id", "customer_text", F.col("lang").alias("intent"), F.col("flag").alias("should_escalate"),
        F.when(F.col("flag"), "toxic").otherwise("clean").alias("escalation_reason"),
        F.col("source").alias("difficulty_stratum"), tx.truncate("customer_text").alias("reference_resolution"),
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The items that need a person, as the curated part of an evaluation set, numbered from 1."""
    curated = gold(spark, sf).where("should_escalate").withColumnRenamed("id", "doc_id")
    return limits.number_all(curated, "doc_id", "id").drop("doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.build_corpus(messages(spark, sf), demo.BRAND)


def case_index(spark: SparkSession, sf: str) -> retrieval.CaseIndex:
    """The pair corpus, indexed and stored in the shared folder once per session."""
    return _stored_index(spark, sf)


@lru_cache(maxsize=8)
def _stored_index(spark: SparkSession, sf: str) -> retrieval.CaseIndex:
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    return retrieval.CaseIndex.build(corpus(spark, sf), demo.RETRIEVER, path=path)


@lru_cache(maxsize=8)
def document_index(spark: SparkSession, sf: str) -> retrieval.CaseIndex:
    """The documents as cases, indexed once per session, in two steps: half of them, then the rest."""
    half = F.col("id") % 2 == 0
    every = docs(spark, sf)
    index = retrieval.CaseIndex.build(every.where(half), demo.RETRIEVER, "id", "customer_text", "source")
    return index.extend(every.where(~half), "id", "customer_text", "source")


def reply_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """An agent turn as reference and the next agent turn as hypothesis."""
    said = messages(spark, sf).where(F.col("author_id") == demo.BRAND)
    later = said.select((F.col("tweet_id") - 2).alias("id"), F.col("text").alias("hypothesis"))
    return said.select(F.col("tweet_id").alias("id"), F.col("text").alias("reference")).join(later, "id")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Order priority and price band as two raters on a five-point scale."""
    band = F.least(F.floor(F.col("o_totalprice") / 100000) + 1, F.lit(5)).cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dimension"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rater_a"), band.alias("rater_b"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Weak label beside the true one."""
    df = labeling.with_label(docs(spark, sf), demo.LEXICON, "customer_text", "predicted")
    return df.select("id", F.col("lang").alias("truth"), F.coalesce("predicted", F.lit("none")).alias("predicted"))


# --- scans and filters ------------------------------------------------------

@query
def scan_messages(spark, sf):
    return messages(spark, sf)


@query
def scan_pairs(spark, sf):
    return drop_incomplete_pairs(corpus(spark, sf)).select(*pairs.PAIR_COLUMNS)


@query
def relevance_filter(spark, sf):
    return pairs.filter_relevant(messages(spark, sf), demo.BRAND, demo.HANDLE).select("tweet_id", "author_id")


@query
def min_length_filter(spark, sf):
    cleaned = docs(spark, sf).select("id", tx.collapse_whitespace("customer_text").alias("customer_text"))
    return cleaned.where(pairs.min_length(["customer_text"]))


@query
def length_band_filter(spark, sf):
    return texts(spark, sf).where(pairs.length_band("customer_text"))


@query
def any_keyword(spark, sf):
    hit = tx.contains_any(F.lower("customer_text"), ["license", "&&&", "idiot", " von "])
    return texts(spark, sf).select("id", hit.alias("hit"))


@query
def word_boundary_match(spark, sf):
    hit = tx.contains_word(F.lower("customer_text"), ["idiot", "loser", "of the", "éon", "thble"])
    return texts(spark, sf).select("id", hit.alias("hit"))


# --- joins, sets, caps --------------------------------------------------------

@query
def reply_pairs(spark, sf):
    return pairs.reply_pairs(messages(spark, sf), demo.BRAND, demo.HANDLE)


@query
def duplicate_keys(spark, sf):
    return limits.duplicate_keys(texts(spark, sf), "customer_text")


@query
def leakage_anti_join(spark, sf):
    return pairs.drop_leaked(texts(spark, sf), gold(spark, sf), "id").select("id", "customer_text")


@query
def seed_union(spark, sf):
    kept = pairs.drop_leaked(texts(spark, sf), gold(spark, sf), "id")
    weak = labeling.weak_labels(kept, demo.LEXICON)
    return labeling.seed_union(gold(spark, sf), weak, ["customer_text", "intent"], "id")


@query
def dedup_keep_first(spark, sf):
    return pairs.dedup_keep_first(docs(spark, sf), "customer_text", "id")


@query
def capped_pairs(spark, sf):
    return pairs.capped_pairs(messages(spark, sf), demo.BRAND, max_pairs=PAIR_CAP)


@query
def weak_training_set(spark, sf):
    kept = pairs.drop_leaked(texts(spark, sf), gold(spark, sf), "id")
    return labeling.training_set(gold(spark, sf), kept, demo.LEXICON)


# --- sampling -------------------------------------------------------------------

def _quota_candidates(spark, sf):
    band = user_turns(spark, sf)
    return labeling.rule_labelled_items(band, demo.EVALUATION_LEXICON, "customer_text", *pairs.LENGTH_BAND)


@query
def quota_sample(spark, sf):
    sampled = sampling.quota_sample(
        _quota_candidates(spark, sf).withColumnRenamed("id", "tweet_id"), None, demo.QUOTAS, "tweet_id")
    return sampled.select("id", "tweet_id", "intent", "customer_text")


@query
def quota_sample_after_seeds(spark, sf):
    """Quotas that the seeds have used up in part, and ids that go on after theirs."""
    sampled = sampling.quota_sample(
        _quota_candidates(spark, sf).withColumnRenamed("id", "tweet_id"), seeds(spark, sf), demo.QUOTAS, "tweet_id")
    return sampled.select("id", "tweet_id", "intent", "customer_text")


@query
def topup_fill(spark, sf):
    items = gold(spark, sf).select("id", "customer_text", "intent", "should_escalate")
    return sampling.topup_fill(
        items, 500, "My device has issues after 11.0.%d", 4, {"intent": "en", "should_escalate": False})


@query
def sample_cases(spark, sf):
    return limits.sample_first(gold(spark, sf), "id", 5)


# --- text functions ---------------------------------------------------------

@query
def normalize_text(spark, sf):
    return texts(spark, sf).select("id", tx.normalize_text("customer_text").alias("clean"))


@query
def collapse_ws(spark, sf):
    return texts(spark, sf).select("id", tx.collapse_whitespace("customer_text").alias("clean"))


@query
def sanitize_reply(spark, sf):
    said = messages(spark, sf).where(~F.col("inbound"))
    return said.select("tweet_id", tx.sanitize_reply("text").alias("clean"))


@query
def repair_text(spark, sf):
    return texts(spark, sf).select("id", tx.repair_text("customer_text").alias("clean"))


@query
def truncate_reply(spark, sf):
    previews = [tx.truncate("text", n).alias(f"preview_{n}") for n in tx.PREVIEW_LENGTHS]
    return messages(spark, sf).select("tweet_id", tx.truncate("text").alias("reply"), *previews)


@query
def tokenize_words(spark, sf):
    tokens = tx.tokenize("customer_text")
    return texts(spark, sf).select("id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query
def tokenize_terms(spark, sf):
    return texts(spark, sf).select(
        "id", F.array_join(tx.tokenize("customer_text", tx.LONG_WORD), " ").alias("long_words"),
        F.array_join(tx.tokenize("customer_text", tx.HYPHEN_WORD), " ").alias("hyphen_words"),
    )


@query
def ngrams(spark, sf):
    grams = tx.ngrams(tx.tokenize("customer_text", tx.LONG_WORD), 1, 3)
    return texts(spark, sf).select("id", F.size(grams).alias("n"), F.array_join(grams, "|").alias("grams"))


@query
def fragment_flag(spark, sf):
    hit = labeling.is_fragment(F.col("customer_text"), demo.FRAGMENTS)
    return texts(spark, sf).select("id", hit.alias("fragment"))


@query
def out_of_scope_flag(spark, sf):
    hit = labeling.is_out_of_scope(F.col("customer_text"), demo.OUT_OF_SCOPE)
    return texts(spark, sf).select("id", hit.alias("out_of_scope"))


# --- labels and rules -----------------------------------------------------------

@query
def weak_labels(spark, sf):
    return labeling.weak_labels(texts(spark, sf), demo.LEXICON).select("id", "intent")


@query
def rule_intent(spark, sf):
    return _quota_candidates(spark, sf).select("id", "intent", "customer_text")


@query
def stratum_rules(spark, sf):
    weak = labeling.weak_labels(texts(spark, sf), demo.LEXICON)
    staged = labeling.stratum_of(weak, demo.STRATUM_RULES, demo.STRATUM_DEFAULT, "customer_text")
    return staged.drop("customer_text")


def _decided(spark, sf):
    return triage.classify_and_decide(texts(spark, sf), demo.WEIGHTS, demo.PACK)


@query
def escalation_decision(spark, sf):
    return _decided(spark, sf).drop("customer_text", "confidence")


@query
def fallback_decision(spark, sf):
    """The production plan without a fitted model: heuristics, else the fallback label."""
    return triage.classify_and_decide(texts(spark, sf), None, demo.PACK).drop("customer_text")


@query
def keyword_escalation(spark, sf):
    decided = escalation.keyword_decision(
        texts(spark, sf), demo.PACK.simple_keywords, demo.PACK.simple_hit_reason,
        demo.PACK.simple_miss_reason)
    return decided.drop("customer_text")


@query
def trigger_breakdown(spark, sf):
    return escalation.trigger_breakdown(_decided(spark, sf))


# --- replies ----------------------------------------------------------------------

@query
def topic_route(spark, sf):
    labelled_docs = demo.WEIGHTS.predict(texts(spark, sf))
    return replies.route_topic(labelled_docs, demo.TOPICS).select("id", "topic", "topic_reply")


@query
def draft_reply(spark, sf):
    """Replies grounded in the document's own text in place of a retrieved case."""
    own = F.array(F.struct(F.col("customer_text").alias("historical_resolution")))
    drafted = replies.draft_reply(
        _decided(spark, sf).withColumn("retrieved", own), demo.TEMPLATES, demo.GENERAL_REPLY, demo.TOPICS,
        demo.DEFAULT_REPLY)
    return drafted.select("id", "trigger_rule", "topic", "drafted_reply")


@query
def length_compliance(spark, sf):
    said = messages(spark, sf).withColumn("side", F.when(F.col("inbound"), "customer").otherwise("agent"))
    return replies.length_compliance(said, "side", "text")


# --- features -----------------------------------------------------------------------

def _simple_model(spark, sf):
    return tfidf.TfidfModel.fit(texts(spark, sf), "customer_text", tfidf.SIMPLE_CLASSIFIER)


@query
def tfidf_vocab(spark, sf):
    return tfidf.vocabulary(texts(spark, sf), "customer_text", tfidf.PRODUCTION_CLASSIFIER)


@query
def tfidf_weights(spark, sf):
    weighted = _simple_model(spark, sf).weights(texts(spark, sf), "id", "customer_text")
    return weighted.select("id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_index(spark, sf):
    return case_index(spark, sf).postings.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --- search ---------------------------------------------------------------------------

@query
def tfidf_cosine(spark, sf):
    """Scores of every message against the pair corpus, summed up per message."""
    scored = retrieval.scores(user_turns(spark, sf), case_index(spark, sf))
    return scored.groupBy("id").agg(
        F.count("*").alias("n_cases"), F.max("score").alias("top_score"),
        F.round(F.sum("score"), 6).alias("total_score"))


@query
def topk_retrieval(spark, sf):
    """The three documents closest to each user turn."""
    best = retrieval.rank_cases(user_turns(spark, sf), document_index(spark, sf), triage.PRODUCTION_K)
    return best.select("id", "doc_id", "score", "rank")


@query
def nearest_1(spark, sf):
    """The stored case closest to each document, with its texts; none for documents without one."""
    found = retrieval.retrieve(texts(spark, sf), case_index(spark, sf), triage.SIMPLE_K)
    best = F.try_element_at("retrieved", F.lit(1))
    return found.select(
        "id", "retrieval_score", F.size("retrieved").alias("n_cases"),
        best["doc_id"].alias("case_id"), best["historical_resolution"].alias("resolution"))


# --- classifiers ----------------------------------------------------------------------

@query
def class_weights(spark, sf):
    weights = classify.class_weights(docs(spark, sf), "lang")
    return weights.select("lang", "n", F.round("weight", 6).alias("weight"))


@query
def majority_class(spark, sf):
    return classify.majority_class(docs(spark, sf), "lang")


def _training_rows(spark, sf):
    return labeling.training_set(
        gold(spark, sf), pairs.drop_leaked(texts(spark, sf), gold(spark, sf), "id"), demo.LEXICON)


@lru_cache(maxsize=8)
def _intent_model(spark, sf, settings=classify.PRODUCTION):
    with shuffles_released(spark):
        return classify.IntentModel.fit(_training_rows(spark, sf), settings)


@query
def fit_certificate(spark, sf):
    """Both fitted classifiers: whether the gradient of the penalised loss vanishes, class by class."""
    train = materialize(_training_rows(spark, sf), "training-rows")
    parts = [
        _intent_model(spark, sf, settings).certificate(train).select(
            F.lit(name).alias("settings"), "intent", "n", "converged")
        for name, settings in (("simple", classify.SIMPLE), ("production", classify.PRODUCTION))]
    return parts[0].unionByName(parts[1])


@query
def train_intent_model(spark, sf):
    """The fitted coefficients; classes x vocabulary rows."""
    return _intent_model(spark, sf).coefficients(spark)


@query
def predict_intent(spark, sf):
    predicted = _intent_model(spark, sf).predict(texts(spark, sf))
    return predicted.select("id", "intent", F.round("confidence", 4).alias("confidence"))


@query
def linear_score(spark, sf):
    scored = demo.WEIGHTS.probabilities(texts(spark, sf), "customer_text", "id")
    return scored.select(
        "id", "label", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query
def confidence_damping(spark, sf):
    predicted = demo.WEIGHTS.predict(texts(spark, sf))
    damped = classify.damp_confidence(
        F.col("intent"), F.col("confidence"), F.col("customer_text"), demo.PACK.damped_label,
        demo.PACK.damped_terms)
    return predicted.select("id", "intent", F.round(damped, 6).alias("confidence"))


@query
def heuristic_override(spark, sf):
    return _decided(spark, sf).select("id", "intent", "confidence")


# --- plans ----------------------------------------------------------------------------

ANSWER = ("id", "intent", "confidence", "should_escalate", "reason", "risk_level", "trigger_rule",
          "drafted_reply")


@query
def trivial_triage(spark, sf):
    return triage.trivial_triage(texts(spark, sf), demo.PACK).select(*ANSWER)


@query
def simple_triage_fitted(spark, sf):
    """The simple plan with its own classifier, fitted on the training set."""
    model = _intent_model(spark, sf, classify.SIMPLE)
    done = triage.simple_triage(texts(spark, sf), model, case_index(spark, sf), demo.PACK)
    return done.select("id", "intent", F.round("confidence", 4).alias("confidence"), "should_escalate", "drafted_reply")


@query
def production_triage_fitted(spark, sf):
    """The production plan with its own classifier, fitted on the training set."""
    done = triage.production_triage(texts(spark, sf), _intent_model(spark, sf), case_index(spark, sf), demo.PACK)
    return done.select("id", "intent", F.round("confidence", 4).alias("confidence"), "trigger_rule", "drafted_reply")


@query
def simple_triage(spark, sf):
    triaged = triage.simple_triage(texts(spark, sf), demo.WEIGHTS, case_index(spark, sf), demo.PACK)
    return triaged.withColumn("confidence", F.round("confidence", 6)).select(*ANSWER, "retrieval_score")


@query
def production_triage(spark, sf):
    triaged = triage.production_triage(texts(spark, sf), demo.WEIGHTS, case_index(spark, sf), demo.PACK)
    cases = F.array_join(F.transform("retrieved", lambda c: c["doc_id"].cast("string")), ",")
    return triaged.select(*ANSWER, "topic", "retrieval_score", cases.alias("cases"))


@query
def stream_triage(spark, sf):
    """The production plan fed by a file stream of user turns, read back when the stream is done."""
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "conversations").schema
    stream = streaming.read_message_stream(spark, f"{sf}/conversations*.parquet", schema)
    asked = stream.select(*raw_message_columns()).where("inbound").select(
        F.col("tweet_id").alias("id"), F.col("text").alias("customer_text"))
    run = streaming.triage_stream(
        asked, demo.WEIGHTS, case_index(spark, sf), demo.PACK, f"{folder}/out", f"{folder}/checkpoint",
        finish=lambda df: df.select(*ANSWER, "retrieval_score"))
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query
def stream_triage_repeats(spark, sf):
    """The stream of user turns with every message coming twice; each is answered once."""
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "conversations").schema
    turns = [streaming.read_message_stream(spark, f"{sf}/conversations*.parquet", schema) for _ in range(2)]
    asked = turns[0].unionByName(turns[1]).select(*raw_message_columns()).where("inbound").select(
        F.col("tweet_id").alias("id"), F.col("text").alias("customer_text"), F.current_timestamp().alias("seen"))
    once = streaming.drop_repeated(asked, "id", "seen", "1 hour").drop("seen")
    run = streaming.triage_stream(
        once, demo.WEIGHTS, case_index(spark, sf), demo.PACK, f"{folder}/out", f"{folder}/checkpoint",
        finish=lambda df: df.select(*ANSWER, "retrieval_score"))
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


# --- evaluation -------------------------------------------------------------------------

@query
def confusion_counts(spark, sf):
    return metrics.confusion_counts(labelled(spark, sf), "truth", "predicted")


@query
def accuracy(spark, sf):
    return metrics.accuracy(confusion_counts(spark, sf)).select(F.round("accuracy", 4).alias("accuracy"))


def _rounded(df, keep, columns, digits=4):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in columns])


@query
def per_class_prf(spark, sf):
    return _rounded(metrics.per_class(confusion_counts(spark, sf)), ["label", "support"],
                    ["precision", "recall", "f1"])


@query
def macro_prf(spark, sf):
    return _rounded(metrics.macro(metrics.per_class(confusion_counts(spark, sf))), [],
                    ["macro_precision", "macro_recall", "macro_f1"])


def _gold_decisions(spark, sf):
    items = gold(spark, sf)
    decided = triage.classify_and_decide(items.select("id", "customer_text"), demo.WEIGHTS, demo.PACK)
    return items.select("id", F.col("should_escalate").alias("truth")).join(
        decided.select("id", F.col("should_escalate").alias("predicted")), "id")


@query
def escalation_metrics(spark, sf):
    return _rounded(
        metrics.escalation_metrics(_gold_decisions(spark, sf), "truth", "predicted"),
        ["tp", "fp", "fn", "tn"], ["precision", "recall", "f1", "false_auto_handle_rate"])


@query
def bleu4(spark, sf):
    scored = lexical.bleu4(reply_drafts(spark, sf), "id", "reference", "hypothesis")
    return _rounded(scored, ["id"], ["bleu_4"], 6)


@query
def rouge_l(spark, sf):
    return _rounded(lexical.rouge(reply_drafts(spark, sf), "id", "reference", "hypothesis"), ["id"],
                    ["rouge_l"], 6)


@query
def pair_cosine(spark, sf):
    return _rounded(lexical.pair_cosine(reply_drafts(spark, sf), "id", "reference", "hypothesis"),
                    ["id"], ["cosine_similarity"], 6)


@query
def lexical_summary(spark, sf):
    return lexical.lexical_summary(reply_drafts(spark, sf), "id", "reference", "hypothesis")


def _rated_pairs(spark, sf):
    said = pairs.reply_pairs(messages(spark, sf), demo.BRAND).withColumnRenamed("agent_text", "drafted_reply")
    flagged = said.withColumn(
        "should_escalate", tx.contains_any(F.lower("customer_text"), [" is ", " que ", " die "]))
    return rubric.score_replies(flagged, PAIR_MARKERS)


# Markers that occur in the invented replies, so that every branch of the rubric fires.
PAIR_MARKERS = {
    "handover": ("ththe", "eaux"), "steps": ("ndthe", "ung der", "les de"),
    "contradiction": (" of ", " to "), "mismatch": (" in ", "inth"),
    "actionable": ("erthe", "ungge"), "canned": ("onthe", "ement de"),
}


@query
def rubric_scores(spark, sf):
    return _rated_pairs(spark, sf).select(
        "response_id", "groundedness", "actionability", "brand_tone", "judge_overall", "judge_reasoning")


@query
def rubric_summary(spark, sf):
    return rubric.rubric_summary(_rated_pairs(spark, sf), "should_escalate")


def _predictions(spark, sf):
    items = gold(spark, sf)
    triaged = triage.production_triage(
        items.select("id", "customer_text"), demo.WEIGHTS, case_index(spark, sf), demo.PACK)
    return evaluation.evaluate_system("production", items, triaged, demo.PACK)


@query
def detailed_predictions(spark, sf):
    return _predictions(spark, sf).drop("customer_text", "system")


@query
def explore_filter(spark, sf):
    return report.explore(_predictions(spark, sf), intent="en", correct=False)


@query
def explore_count(spark, sf):
    return report.explore_count(_predictions(spark, sf), correct=True)


@query
def facet_values(spark, sf):
    return report.facet_values(
        gold(spark, sf).withColumnRenamed("intent", "gold_intent"), ["difficulty_stratum", "gold_intent"])


SYSTEMS = ("trivial", "simple", "production")


def _all_predictions(spark, sf):
    items = gold(spark, sf)
    asked = items.select("id", "customer_text")
    # Two systems search the same index: one search, stored, serves both (the nearest is the first).
    searched = retrieval.retrieve(asked, case_index(spark, sf), triage.PRODUCTION_K)
    with shuffles_released(spark):
        found = materialize(searched, "found")
    answers = {
        "trivial": triage.trivial_triage(asked, demo.PACK),
        "simple": triage.simple_answers(found, demo.WEIGHTS, demo.PACK),
        "production": triage.production_answers(found, demo.WEIGHTS, demo.PACK),
    }
    tables = [evaluation.evaluate_system(name, items, answers[name], demo.PACK) for name in SYSTEMS]
    return reduce(DataFrame.unionByName, tables)


def _metric_table(spark, sf):
    """Several metrics read the predictions, or the small cube of them, so both are stored once."""
    predictions = materialize(_all_predictions(spark, sf), "predictions")
    cube = materialize(evaluation.evaluation_cube(predictions), "cube")
    items = gold(spark, sf)
    lexical_rows = [
        evaluation.lexical_metrics(name, predictions.where(F.col("system") == name), items) for name in SYSTEMS]
    return reduce(DataFrame.unionByName, [evaluation.metric_table(cube), *lexical_rows])


@query
def system_comparison(spark, sf):
    return report.system_comparison(_metric_table(spark, sf), SYSTEMS)


@query
def recall_vs_far(spark, sf):
    cube = evaluation.evaluation_cube(_all_predictions(spark, sf))
    rates = metrics.escalation_metrics(cube, "gold_escalate", "predicted_escalate", ("system",), "n")
    return _rounded(metrics.recall_vs_far(rates), ["system", "measure"], ["value"])


@query
def breakdown_counts(spark, sf):
    return sampling.breakdown_counts(gold(spark, sf), ["intent", "should_escalate", "difficulty_stratum"])


# --- agreement ----------------------------------------------------------------------------

@query
def agreement_rates(spark, sf):
    rates = ag.agreement_rates(ag.rating_counts(ratings(spark, sf)))
    return _rounded(rates, ["dimension", "sample_size"],
                    ["exact_agreement_pct", "adjacent_agreement_pct", "mean_bias"])


@query
def weighted_kappa(spark, sf):
    return _rounded(ag.weighted_kappa(ag.rating_counts(ratings(spark, sf))), ["dimension"], ["kappa"], 6)


@query
def rater_pearson(spark, sf):
    return _rounded(ag.rater_pearson(ag.rating_counts(ratings(spark, sf))), ["dimension"], ["pearson_r"], 6)


@query
def agreement_macro(spark, sf):
    return ag.agreement_macro(ag.agreement(ratings(spark, sf)))


@query
def evaluation_set(spark, sf):
    """Corpus to evaluation set in one plan: repair, label, sample by quota, stratify."""
    built = dataprep.build_evaluation_set(
        corpus(spark, sf), None, demo.EVALUATION_LEXICON, demo.STRATUM_RULES, demo.STRATUM_DEFAULT,
        demo.QUOTAS, 20)
    return built


@query
def evaluation_set_after_seeds(spark, sf):
    """The same, with seeds first."""
    return dataprep.build_evaluation_set(
        corpus(spark, sf), seeds(spark, sf), demo.EVALUATION_LEXICON, demo.STRATUM_RULES, demo.STRATUM_DEFAULT,
        demo.QUOTAS, 20)


# --- files: written by the library's sinks and read back by its readers --------------------

def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def messages_through_csv(spark, sf):
    """The raw dump as CSV, then as Parquet."""
    path = _folder(spark, "messages")
    raw = messages(spark, sf).withColumn("response_tweet_id", F.lit(None).cast("string"))
    writers.write_table(raw.select(*schemas.RAW_MESSAGES.names), path, "csv")
    return readers.ingest_messages(spark, path, f"{path}-parquet")


@query
def evaluation_items_through_json(spark, sf):
    """The evaluation set as lines of JSON."""
    path = _folder(spark, "items")
    writers.write_table(gold(spark, sf).select(*schemas.EVALUATION_ITEMS.names), path, "json")
    items = readers.read_evaluation_items(spark, path, "jsonl")
    return validate_input(items, schemas.EVALUATION_ITEMS.names, "the evaluation set builder")


@query
def calibration_through_json(spark, sf):
    """Orders as items that two raters scored on three dimensions."""
    path = _folder(spark, "calibration")
    a, b = F.substring("o_orderpriority", 1, 1).cast("int"), F.least(
        F.floor(F.col("o_totalprice") / 100000) + 1, F.lit(5)).cast("int")

    def scores(first, second, third):
        return F.struct(first.alias("groundedness"), second.alias("actionability"), third.alias("brand_tone"))

    nothing = F.lit("")
    records = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("id"), nothing.alias("customer_text"), nothing.alias("drafted_reply"),
        scores(a, b, 6 - a).alias("human_scores"), scores(b, b, a).alias("judge_scores"),
        nothing.alias("human_notes"), nothing.alias("judge_reasoning"))
    writers.write_table(records, path, "json")
    return readers.read_calibration(spark, path, multi_line=False)


@query
def predictions_through_csv(spark, sf):
    """The detailed predictions as CSV."""
    path = _folder(spark, "predictions")
    writers.write_table(_predictions(spark, sf).select(*schemas.DETAILED_PREDICTIONS.names), path, "csv")
    return readers.read_predictions(spark, path, "csv").drop("customer_text")


@query
def metrics_through_json(spark, sf):
    """The metric table as JSON; the rows without a label."""
    path = _folder(spark, "metrics")
    writers.write_summary(_metric_table(spark, sf), path)
    kept = readers.read_metrics(spark, path, "json").where(F.col("label").isNull())
    return kept.select("system", "metric_group", "metric", "value")

"""The three triage plans (P1-P3): a message table in, decisions and replies out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgtriage.operators.classify import Constant, production_intent
from msgtriage.operators.escalation import decide, keyword_decision, never_escalate
from msgtriage.operators.replies import constant_reply, draft_reply, verbatim_reply
from msgtriage.operators.retrieval import CaseIndex, retrieve
from msgtriage.packs import TriagePack

SIMPLE_K = 1      # fixed value
PRODUCTION_K = 3  # fixed value


def trivial_triage(messages: DataFrame, pack: TriagePack) -> DataFrame:
    """The majority label, no escalation, one reply for all. Narrow."""
    labelled = Constant(pack.majority).predict(messages)
    return constant_reply(never_escalate(labelled, pack.trivial_reason), pack.trivial_reply)


def simple_answers(found: DataFrame, model, pack: TriagePack) -> DataFrame:
    """P2 after the search: model label, keyword escalation, verbatim nearest reply. Narrow."""
    decided = keyword_decision(
        model.predict(found), pack.simple_keywords, pack.simple_hit_reason, pack.simple_miss_reason
    )
    return verbatim_reply(decided, pack.simple_fallback_reply)


def classify_and_decide(messages: DataFrame, model, pack: TriagePack) -> DataFrame:
    """The first half of P3: intent, confidence and escalation decision of each message. Narrow."""
    labelled = production_intent(
        messages, model, pack.fragments, pack.out_of_scope, pack.fragment_label,
        pack.out_of_scope_label, pack.damped_label, pack.damped_terms, pack.majority,
    )
    return decide(labelled, pack.escalation_rules, pack.escalation_default)


def production_answers(found: DataFrame, model, pack: TriagePack) -> DataFrame:
    """P3 after the search: classify, decide, draft. Narrow."""
    return draft_reply(
        classify_and_decide(found, model, pack), pack.reply_templates, pack.general_reply, pack.topics,
        pack.default_reply,
    )


def simple_triage(messages: DataFrame, model, index: CaseIndex, pack: TriagePack) -> DataFrame:
    """P2; needs ``id`` and ``customer_text``."""
    return simple_answers(retrieve(messages, index, SIMPLE_K), model, pack)


def production_triage(messages: DataFrame, model, index: CaseIndex, pack: TriagePack) -> DataFrame:
    """P3; needs ``id`` and ``customer_text``.

    Classification, rules and templates are expressions on the row; only the
    search moves data, once, by message id. The rule that fired stays in the output.
    """
    return production_answers(retrieve(messages, index, PRODUCTION_K), model, pack)


def output_columns(triaged: DataFrame) -> DataFrame:
    """M8: the columns of one agent answer."""
    return triaged.select(
        "id", "customer_text", "intent", "confidence", "should_escalate",
        F.col("reason").alias("escalation_reason"), "risk_level", "trigger_rule", "drafted_reply",
        "retrieved",
    )

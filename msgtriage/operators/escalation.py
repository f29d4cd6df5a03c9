"""Escalation decisions (G7-G17) from a rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from msgtriage.functions.rules import Rule, first_match
from msgtriage.functions.text import contains_any, sql_string

DECISION_COLUMNS = ("should_escalate", "reason", "risk_level", "trigger_rule")


def decide(
    df: DataFrame, rules: Sequence[Rule], default: Mapping, text: str = "customer_text",
) -> DataFrame:
    """The first rule that holds decides; needs ``intent`` and ``confidence``."""
    names = {"text": "_lower", "intent": "intent", "confidence": "confidence"}
    return (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("_decision", first_match(rules, names, default))
        .select(*df.columns, "_decision.*")
    )


def low_confidence_reason(pattern: str, threshold: float):
    """a reason that quotes the confidence and the threshold to two decimals."""
    def reason(names: Mapping[str, str]) -> str:
        return f"format_string({sql_string(pattern)}, `{names['confidence']}`, {float(threshold)}D)"

    return reason


def keyword_decision(
    df: DataFrame, keywords: Sequence[str], hit_reason: str, miss_reason: str,
    text: str = "customer_text",
) -> DataFrame:
    """Escalate on any keyword."""
    hit = contains_any("_lower", keywords)
    flagged = df.withColumn("_lower", F.lower(F.col(text))).withColumn("should_escalate", hit)
    return flagged.select(
        *df.columns,
        "should_escalate",
        F.when(F.col("should_escalate"), hit_reason).otherwise(miss_reason).alias("reason"),
        F.when(F.col("should_escalate"), "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.lit("KEYWORD_RULE").alias("trigger_rule"),
    )


def never_escalate(df: DataFrame, reason: str) -> DataFrame:
    """The baseline that leaves everything to the machine."""
    return df.select(
        *df.columns, F.lit(False).alias("should_escalate"), F.lit(reason).alias("reason"),
        F.lit("LOW").alias("risk_level"), F.lit("TRIVIAL_DEFAULT").alias("trigger_rule"),
    )


def trigger_breakdown(decisions: DataFrame) -> DataFrame:
    """How often each rule fired, per risk level."""
    return decisions.groupBy("trigger_rule", "risk_level").agg(F.count("*").alias("n"))

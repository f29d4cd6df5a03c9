"""Reply assembly from templates and grounded cases (H1-H7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.functions.rules import Rule, first_match
from msgtriage.functions.text import blank_handles, sanitize_reply, sql_string, truncate, within_limit

GROUNDED_BAND = (26, 275)  # fixed value: lengths of a historical reply fit for reuse


def escalation_reply(trigger: str, templates: Mapping[str, str], general: str) -> Column:
    """H1: the hand-over text of the rule that fired, else the general one."""
    whens = " ".join(f"WHEN {sql_string(n)} THEN {sql_string(t)}" for n, t in templates.items())
    return F.expr(f"CASE `{trigger}` {whens} ELSE {sql_string(general)} END")


def route_topic(df: DataFrame, topics: Sequence[Rule], text: str = "customer_text") -> DataFrame:
    """H2 with F5: add ``topic`` and ``topic_reply`` of the first topic that matches; null if none.

    Handles are blanked first, so a word inside a handle is not a topic word.
    """
    names = {"text": "_bare", "intent": "intent"}
    return (
        df.withColumn("_bare", blank_handles(F.lower(F.col(text))))
        .withColumn("_topic", first_match(topics, names, None))
        .select(
            *df.columns,
            F.col("_topic.topic").alias("topic"), F.col("_topic.template").alias("topic_reply"),
        )
    )


def grounded_reply(resolution: Column) -> Column:
    """H3: the sanitised best historical reply, if its length suits; else null."""
    low, high = GROUNDED_BAND
    return F.when(F.char_length(resolution).between(low, high), resolution)


def draft_reply(
    df: DataFrame, templates: Mapping[str, str], general: str, topics: Sequence[Rule], default: str,
    text: str = "customer_text",
) -> DataFrame:
    """H1-H4: hand-over text if escalated, else topic, grounded or default reply.

    Needs ``intent``, ``should_escalate``, ``trigger_rule`` and ``retrieved``.
    """
    routed = route_topic(df, topics, text)
    best = F.try_element_at("retrieved", F.lit(1)).getField("historical_resolution")
    grounded = routed.withColumn("_best", sanitize_reply(best))
    automatic = F.coalesce(F.col("topic_reply"), grounded_reply(F.col("_best")), F.lit(default))
    reply = F.when(
        F.col("should_escalate"), escalation_reply("trigger_rule", templates, general)
    ).otherwise(automatic)
    return grounded.select(*df.columns, "topic", truncate(reply).alias("drafted_reply"))


def verbatim_reply(df: DataFrame, fallback: str) -> DataFrame:
    """H5: the best historical reply as it is, cut to the limit."""
    best = F.try_element_at("retrieved", F.lit(1)).getField("historical_resolution")
    return df.withColumn("drafted_reply", truncate(F.coalesce(best, F.lit(fallback))))


def constant_reply(df: DataFrame, reply: str) -> DataFrame:
    """H6."""
    return df.withColumn("drafted_reply", F.lit(reply))


def length_compliance(df: DataFrame, by: str, reply: str = "drafted_reply") -> DataFrame:
    """H7: replies within the limit, per group."""
    fits = within_limit(reply)
    return df.groupBy(by).agg(
        F.count(reply).alias("n"), F.count_if(fits).alias("compliant"),
        F.try_divide(F.count_if(fits), F.count(reply)).alias("rate"),
    )

"""Data preparation (L3): messages to corpus, corpus to a labelled evaluation set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from msgtriage.functions.rules import Rule
from msgtriage.functions.text import repair_text
from msgtriage.operators.labeling import rule_labelled_items, stratum_of
from msgtriage.operators.pairs import LENGTH_BAND
from msgtriage.operators.sampling import EVALUATION_SIZE, quota_sample


def build_evaluation_set(
    corpus: DataFrame, seeds: DataFrame | None, lexicon, strata: Sequence[Rule],
    stratum_default: Mapping, quotas: Mapping[str, int], default_quota: int,
    size: int = EVALUATION_SIZE, key: str = "response_id",
) -> DataFrame:
    """Seeds first, then corpus rows accepted class by class in key order; no filler rows."""
    low, high = LENGTH_BAND
    labelled = rule_labelled_items(corpus, lexicon, "customer_text", low, high)
    chosen = quota_sample(labelled, seeds, quotas, key, size, default_quota)
    items = stratum_of(chosen, strata, stratum_default, "customer_text").select(
        "id", "customer_text", "intent", "should_escalate", "escalation_reason", "difficulty_stratum",
        repair_text("agent_text").alias("reference_resolution"),
    )
    return items if seeds is None else seeds.select(*items.columns).unionByName(items)


def messages_of(pairs: DataFrame, key: str = "inquiry_id") -> DataFrame:
    """The customer side of a pair table as a message table."""
    return pairs.select(F.col(key).alias("id"), "customer_text")

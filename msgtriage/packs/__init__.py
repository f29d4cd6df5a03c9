"""Rule packs: lexicons, templates and thresholds as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from msgtriage.functions.rules import Rule


@dataclass(frozen=True)
class TriagePack:
    """All domain content that the triage plans read."""

    brand: str
    handle: str
    lexicon: Sequence[tuple[str, Sequence[str]]]
    majority: str
    fragments: Sequence[str]
    out_of_scope: Sequence[str]
    fragment_label: str
    out_of_scope_label: str
    damped_label: str
    damped_terms: Sequence[str]
    escalation_rules: Sequence[Rule]
    escalation_default: Mapping
    reply_templates: Mapping[str, str]
    general_reply: str
    topics: Sequence[Rule]
    default_reply: str
    simple_keywords: Sequence[str]
    simple_hit_reason: str
    simple_miss_reason: str
    simple_fallback_reply: str
    trivial_reason: str
    trivial_reply: str
    rubric_markers: Mapping[str, tuple[str, ...]]

"""A pack for the invented prose of the test tables.

The language of a text plays the part of its intent, and insults play the part
of hazards and threats. Every branch fires on the test tables.
"""

from __future__ import annotations

from msgtriage.functions.rules import Rule, confidence_below, intent_is, substring, word
from msgtriage.operators.classify import LinearWeights
from msgtriage.operators.escalation import low_confidence_reason
from msgtriage.operators.tfidf import TfidfConfig
from msgtriage.packs import TriagePack

BRAND = "brand"
HANDLE = "the"

LEXICON = [
    ("en", [" the ", " of ", " and "]),
    ("de", [" der ", " und ", " die "]),
    ("fr", [" le ", " des ", " et "]),
    ("es", [" de la ", " que ", " el ", " los "]),
]
# A second lexicon, as the evaluation set has its own.
EVALUATION_LEXICON = [
    ("en", [" that ", " with ", " this "]),
    ("de", [" ein", " das "]),
    ("fr", [" les ", " est "]),
    ("es", [" los ", " por "]),
]
QUOTAS = {"en": 40, "de": 25, "fr": 30, "es": 12}

STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "der", "die", "und", "le", "la", "de", "des", "que",
    "el",
)
RETRIEVER = TfidfConfig(1, 2, sublinear=True, stop_words=STOP_WORDS)

WEIGHTS = LinearWeights(
    weights={
        "en": {"the": 1.2, "of": 0.9, "and": 0.9, "to": 0.6, "is": 0.5},
        "de": {"der": 1.4, "die": 1.1, "und": 1.1, "den": 0.7, "von": 0.6},
        "fr": {"le": 1.1, "les": 1.3, "des": 1.2, "et": 0.9, "la": 0.3},
        "es": {"el": 1.3, "los": 1.2, "que": 0.6, "y": 0.9, "la": 0.4},
    },
    bias={"en": 0.3, "de": 0.0, "fr": 0.0, "es": -0.1},
)

FRAGMENTS = ("that it.", "von.", "osrañ.", "reorea. nd.", "erinst resh.")
OUT_OF_SCOPE = ("***", "###", " | ")
THRESHOLD = 0.60


def _escalate(reason, risk, trigger, should=True):
    return {"should_escalate": should, "reason": reason, "risk_level": risk, "trigger_rule": trigger}


ESCALATION_RULES = [
    Rule("hazard", all_of=(word("idiot", "moron", "scum"),),
         yields=_escalate("hazard word", "CRITICAL", "HAZARD")),
    Rule("legal", all_of=(word("trash", "worthless", "loser", "clown"),),
         yields=_escalate("threat word", "HIGH", "THREAT")),
    Rule("account", all_of=(intent_is("de"),), yields=_escalate("sensitive intent", "HIGH", "SENSITIVE")),
    Rule("billing", all_of=(intent_is("fr"), substring("eaux", "ieraux")),
         yields=_escalate("disputed intent", "MEDIUM", "DISPUTE")),
    Rule("fragment", all_of=(intent_is("fragment"),),
         yields=_escalate("fragment", "MEDIUM", "FRAGMENT")),
    Rule("store", all_of=(substring("license"), substring(" with ", " that ", " mit ", " les ")),
         yields=_escalate("store visit", "MEDIUM", "STORE")),
    Rule("uncertain", all_of=(confidence_below(THRESHOLD),),
         yields=_escalate(low_confidence_reason("confidence %.2f below %.2f", THRESHOLD), "LOW",
                          "UNCERTAIN")),
]
ESCALATION_DEFAULT = _escalate("routine", "LOW", "ROUTINE", should=False)

TEMPLATES = {
    "HAZARD": "Please stop using it and write to us in a DM; your safety matters most.",
    "THREAT": "A colleague will read this today. Send a DM so that we can reach you.",
    "SENSITIVE": "Accounts are handled at https://example.com/recover and nowhere else.",
    "DISPUTE": "Let us go through this charge together in a DM.",
    "FRAGMENT": "A few more words about it would help us.",
}
GENERAL_REPLY = "Write to us directly with the details and we will look into it."


def _topic(name, template, *any_of):
    return Rule(name, any_of=any_of, yields={"topic": name, "template": template})


TOPICS = [
    _topic("heat", "Let it cool down first: settings > power.", word("thble", "thnd")),
    _topic("cable", "Try another cable, see https://example.com/cable for more.",
           word("thor", "erha"), word("of the")),
    _topic("battery", "Open settings > battery and tell us the figure.", word("thon", "eron")),
    _topic("backup", "Open settings > storage to see what fills it.", word("anea"), intent_is("fr")),
    _topic("feedback", "Thank you for telling us.", intent_is("es")),
    _topic("out_of_scope", "We can only help with our own products.", intent_is("out_of_scope")),
]
DEFAULT_REPLY = "Which version is this about? That will help us find the cause."

RUBRIC_MARKERS = {
    "handover": ("dm", "safety"),
    "steps": ("settings >", "example.com", "restart"),
    "contradiction": ("and the", "settings"),
    "mismatch": ("that", "help"),
    "actionable": ("settings >", "dm", "https://"),
    "canned": ("thank you for telling",),
}


def _stratum(should, reason, stratum):
    return {"should_escalate": should, "escalation_reason": reason, "difficulty_stratum": stratum}


STRATUM_RULES = [
    Rule("high stakes", all_of=(intent_is("de", "es"),), yields=_stratum(True, "policy", "account")),
    Rule("agitated", all_of=(substring("erst", "eaux", "hate"),), yields=_stratum(True, "agitated", "hostile")),
    Rule("several", all_of=(substring(" and ", " et "),), yields=_stratum(False, "several issues", "several")),
]
STRATUM_DEFAULT = _stratum(False, "routine", "routine")

PACK = TriagePack(
    brand=BRAND,
    handle=HANDLE,
    lexicon=LEXICON,
    majority="en",
    fragments=FRAGMENTS,
    out_of_scope=OUT_OF_SCOPE,
    fragment_label="fragment",
    out_of_scope_label="out_of_scope",
    damped_label="de",
    damped_terms=(" und ", " den "),
    escalation_rules=ESCALATION_RULES,
    escalation_default=ESCALATION_DEFAULT,
    reply_templates=TEMPLATES,
    general_reply=GENERAL_REPLY,
    topics=TOPICS,
    default_reply=DEFAULT_REPLY,
    simple_keywords=("idiot", "trash", "license"),
    simple_hit_reason="keyword",
    simple_miss_reason="no keyword",
    simple_fallback_reply="Send us a DM and we will help.",
    trivial_reason="never",
    trivial_reply="Noted. Tell us the version in a DM.",
    rubric_markers=RUBRIC_MARKERS,
)

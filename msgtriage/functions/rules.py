"""Rule tables compiled to first-match CASE WHEN expressions.

A rule is data: a name, conditions and the values it yields. Compiling a table
gives one narrow SQL expression over named columns, so a cascade never shuffles,
CASE WHEN stops at the first branch that holds, and the driver hands Spark one
expression instead of hundreds of small ones, which counts when a stream plans
every micro-batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.functions.text import contains_any_sql, contains_word_sql, sql_string

MAX_RULES = 10_000


@dataclass(frozen=True)
class Condition:
    """One test: ``substring`` and ``word`` read the text, the others the prediction."""

    kind: str  # substring | word | intent | confidence_below
    values: tuple = ()

    def sql(self, names: Mapping[str, str]) -> str:
        if self.kind == "substring":
            return contains_any_sql(names["text"], self.values)
        if self.kind == "word":
            return contains_word_sql(names["text"], self.values)
        if self.kind == "intent":
            listed = ", ".join(map(sql_string, self.values))
            return f"coalesce(`{names['intent']}` IN ({listed}), false)"
        if self.kind == "confidence_below":
            return f"coalesce(`{names['confidence']}` < {float(self.values[0])}D, false)"
        raise ValueError(f"unknown condition kind {self.kind!r}")


def substring(*values: str) -> Condition:
    return Condition("substring", values)


def word(*values: str) -> Condition:
    return Condition("word", values)


def intent_is(*values: str) -> Condition:
    return Condition("intent", values)


def confidence_below(value: float) -> Condition:
    return Condition("confidence_below", (value,))


@dataclass(frozen=True)
class Rule:
    """All of ``all_of`` and, if given, at least one of ``any_of`` must hold."""

    name: str
    all_of: tuple[Condition, ...] = ()
    any_of: tuple[Condition, ...] = ()
    yields: Mapping[str, Any] = field(default_factory=dict)

    def sql(self, names: Mapping[str, str]) -> str:
        tests = [c.sql(names) for c in self.all_of]
        if self.any_of:
            tests.append("(" + " OR ".join(c.sql(names) for c in self.any_of) + ")")
        return " AND ".join(tests) or "true"


def _value(v: Any, names: Mapping[str, str]) -> str:
    if callable(v):
        return v(names)
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return sql_string(v)
    raise TypeError(f"a rule yields texts and flags, not {type(v).__name__}")


def first_match(
    rules: Sequence[Rule], names: Mapping[str, str], default: Mapping[str, Any] | None,
) -> Column:
    """A struct of the first matching rule's ``yields``; null if none and no default.

    ``names`` says which columns hold ``text``, ``intent`` and ``confidence``. A
    yielded value may be a function of them that returns SQL (a formatted reason).
    """
    fields = list(rules[0].yields)

    def branch(values: Mapping[str, Any]) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {_value(values[n], names)}" for n in fields) + ")"

    whens = " ".join(f"WHEN {rule.sql(names)} THEN {branch(rule.yields)}" for rule in rules)
    otherwise = f" ELSE {branch(default)}" if default is not None else ""
    return F.expr(f"CASE {whens}{otherwise} END")


def lexicon_label(lowered: str, lexicon: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first entry, in order, one of whose keywords occurs in the lower-cased text.

    Takes the name of a column that already holds the lower-cased text, so it is lowered once.
    """
    whens = " ".join(
        f"WHEN {contains_any_sql(lowered, keywords)} THEN {sql_string(label)}" for label, keywords in lexicon
    )
    return F.expr(f"CASE {whens} END")


def lexicon_from_table(table: DataFrame) -> list[tuple[str, list[str]]]:
    """Read a ``(priority, intent, keywords)`` table into an ordered lexicon.

    A rule table is configuration; its size is checked before it reaches the driver.
    """
    rows = table.orderBy("priority").select("intent", "keywords").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a lexicon may have at most {MAX_RULES} entries")
    return [(r["intent"], list(r["keywords"])) for r in rows]

"""Chat formatting with a grammar round trip.

A conversation is rendered by this grammar::

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A control string is ``<``, any number of backslashes, ``|im_start|>`` or
``|im_end|>``. In the output a bare one (no backslash) is a mark of the grammar,
and one with backslashes stands for itself with one backslash less. Rendering
does not escape by rule: a turn is rendered as it is, read back by the parser,
and compared with its source. While they differ, each control string of the
text gets one more backslash. A text without control strings is never changed.
In a role, backslash and line feed are escaped on the same condition.

The loss mask covers the text of assistant turns, without marks.

Rendering looks at one turn and moves nothing. The digests of a conversation need
its turns in order: rows are dealt by conversation, sorted on disk if need be,
and folded one at a time, so memory holds one turn and a few hash states, however
long the conversation is. A digest is sequential by definition, so one
conversation is read by one task, as a stream.

Null texts and roles are empty. Turns go by (turn, role, text), nulls first;
repeated rows are turns of their own. A null conversation id is an id like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|im_(start|end)\|>")
TRAINED_ROLE = "assistant"


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    #: Where the escaped text lies in the parsed string.
    start: int = 0
    end: int = 0


def escape(text: str) -> str:
    """One more backslash in every control string."""
    return CONTROL.sub(lambda m: f"<\\{m[1]}|im_{m[2]}|>", text)


def unescape(text: str) -> str:
    """One backslash less in every control string that has one."""
    return CONTROL.sub(lambda m: f"<{m[1][1:]}|im_{m[2]}|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def render_raw(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[Turn]:
    """The turns of a rendered conversation; reads from left to right, without going back."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        head = rendered.find("\n", at)
        if head < 0:
            raise GrammarError(f"the role at {at} has no end")
        role = rendered[at + len(START):head]
        if START in role or END in role:
            raise GrammarError(f"a mark in the role at {at}")
        close = rendered.find(END, head + 1)
        if close < 0:
            raise GrammarError(f"the turn at {at} has no end")
        text = rendered[head + 1:close]
        if START in text:
            raise GrammarError(f"a turn starts inside the turn at {at}")
        after = close + len(END)
        if not rendered.startswith("\n", after):
            raise GrammarError(f"no line feed at {after}")
        turns.append(Turn(unescape_role(role), unescape(text), head + 1, close))
        at = after + 1
    return turns


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        found = parse(rendered)
    except GrammarError:
        return False
    return len(found) == 1 and (found[0].role, found[0].text) == (role, text)


def render(role: str, text: str) -> str:
    """One turn in the template, escaped until it reads back as its source."""
    written_role, written = role, text
    if not _reads_back(render_raw(role, ""), role, ""):
        written_role = escape_role(role)
    while not _reads_back(rendered := render_raw(written_role, written), role, text):
        written = escape(written)
    return rendered


RENDERED = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_start", T.LongType()),
    T.StructField("loss_end", T.LongType()),
])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted; loss_start and loss_end bound the trained part of ``formatted``.

    Without a trained part the two are null. The formatted conversation is the
    turns' ``formatted`` in order, nothing between.
    """

    @F.pandas_udf(RENDERED)
    def rendered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            rows = []
            for role, text in zip(roles, texts):
                out = render(role, text)
                turn = parse(out)[0]
                trained = role == TRAINED_ROLE
                rows.append((out, turn.start if trained else None, turn.end if trained else None))
            out = pd.DataFrame(rows, columns=RENDERED.names)
            yield out.astype({"loss_start": "Int64", "loss_end": "Int64"})

    turns = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.withColumn("r", rendered("role", "text")).select("conv_id", "turn", "role", "text", "r.*")


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")


class _Fold:
    """What is known of one conversation while its turns pass."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start, loss_end) -> None:
        self.chars += len(formatted)
        for turn in parse(formatted):
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
        if loss_start is not None:
            text = unescape(formatted[loss_start:loss_end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_turns``: turns, loss text and length."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = DIGEST_SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        current: _Fold | None = None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

        for batch in batches:
            done = []
            for conv, known, text, masked, start, end in batch.itertuples(index=False):
                key = int(conv) if known else None
                if current is None or current.conv_id != key:
                    if current is not None:
                        done.append(current.row())
                    current = _Fold(key)
                current.add(text, int(start) if masked else None, int(end) if masked else None)
            if done:
                yield frame(done)
        if current is not None:
            yield frame([current.row()])

    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_order.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("known"), "formatted",
        F.col("loss_start").isNotNull().alias("masked"), F.coalesce("loss_start", F.lit(0)).alias("start"),
        F.coalesce("loss_end", F.lit(0)).alias("end"),
    ).mapInPandas(fold, DIGEST_SCHEMA)

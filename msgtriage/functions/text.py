"""Text functions, each Column -> Column, all evaluated inside the JVM.

Python's ``\\w`` and ``\\s`` are Unicode classes while Java's are ASCII, so the
classes are spelled out. Letters, numbers and the underscore make a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
_SPACES = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters one by one.
SPACE_CHARACTERS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
SPACE_RUN = f"[{_SPACES}]+"
NOT_SPACE = f"[^{_SPACES}]"
# Listed, since Java matches an excluding class of several ranges some nine times slower.
NOT_ASCII_OR_SPACE_RUN = r"[\x09-\x0d\x1c-\x20\x{80}-\x{10ffff}]+"

# Token shapes: any word; words of two or more characters; words with inner hyphens.
ANY_WORD = f"{WORD}+"
LONG_WORD = f"{WORD}{{2,}}"
HYPHEN_WORD = rf"{WORD}[\p{{L}}\p{{N}}_-]*{WORD}"

# The curly and the mis-decoded apostrophe, the canonical support
# link, the reply limit and the preview lengths.
APOSTROPHES = "’\u0092"
SUPPORT_LINK = "https://apple.co/support"
REPLY_LIMIT = 280
PREVIEW_LENGTHS = (90, 120, 140)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A lambda that mentions an outer expression evaluates it again for every
    element; binding it to a lambda variable first keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def explode_structs(df: DataFrame, keep: Sequence[str], structs: Column) -> DataFrame:
    """One row per struct of a computed array, beside the ``keep`` columns; none for an empty array.

    The inner form of ``inline`` makes the optimizer test the array's size in a
    filter below, which computes the whole array a second time. The outer form
    does not; its one null row per empty array is removed afterwards.
    """
    exploded = df.select(*keep, F.inline_outer(structs))
    first = exploded.columns[len(keep)]
    return exploded.where(F.col(first).isNotNull())


# --- normalisers -----------------------------------------------------------

def collapse_whitespace(c: Column | str) -> Column:
    """every run of whitespace becomes one space; ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE_RUN, " "))


def blank_handles(c: Column | str) -> Column:
    """each ``@handle`` becomes a space."""
    return F.regexp_replace(text_or_empty(c), f"@{WORD}+", " ")


def normalize_text(c: Column | str) -> Column:
    """drop handles, links and non-ASCII runs, then collapse whitespace.

    Few texts have a handle or a link, and a substring is found far faster than a pattern; blanking
    handles makes no link. Runs of whitespace and of what is not ASCII become one space in one pass.
    """
    def where_found(needle: str, replaced: Column, else_: Column) -> Column:
        return F.when(F.contains(text_or_empty(c), F.lit(needle)), replaced).otherwise(else_)

    bare = where_found("@", blank_handles(c), text_or_empty(c))
    no_links = where_found("://", F.regexp_replace(bare, f"https?://{NOT_SPACE}+", " "), bare)
    return F.trim(F.regexp_replace(no_links, NOT_ASCII_OR_SPACE_RUN, " "))


def strip_leading_handle(c: Column | str) -> Column:
    """remove one handle at the start, with the whitespace after it."""
    return F.regexp_replace(text_or_empty(c), f"^@{WORD}+[{_SPACES}]*", "")


def plain_apostrophes(c: Column | str) -> Column:
    return F.translate(_col(c), APOSTROPHES, "'" * len(APOSTROPHES))


def sanitize_reply(c: Column | str, link: str = SUPPORT_LINK) -> Column:
    """a historical reply without numeric handles and with canonical links."""
    no_handles = F.regexp_replace(text_or_empty(c), r"@\p{Nd}+", "")
    linked = F.regexp_replace(no_handles, rf"https?://t\.co/{WORD}+", link)
    return collapse_whitespace(plain_apostrophes(linked))


def trim_whitespace(c: Column | str) -> Column:
    """Whitespace of any kind off both ends; null is empty. Reads the ends only."""
    return F.btrim(text_or_empty(c), F.lit(SPACE_CHARACTERS))


def repair_text(c: Column | str) -> Column:
    """trim, plain apostrophes, each pair of spaces made one."""
    return F.replace(plain_apostrophes(trim_whitespace(c)), F.lit("  "), F.lit(" "))


def truncate(c: Column | str, limit: int = REPLY_LIMIT) -> Column:
    """F8: the first ``limit`` characters."""
    return F.substring(_col(c), 1, limit)


def word_count(c: Column | str) -> Column:
    """number of whitespace-separated words."""
    return let(
        collapse_whitespace(c),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))),
    )


def within_limit(c: Column | str, limit: int = REPLY_LIMIT) -> Column:
    """H7: the reply fits the channel."""
    return F.char_length(_col(c)) <= limit


# --- predicates ------------------------------------------------------------

def escape_regex(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any_sql(name: str, needles: Iterable[str]) -> str:
    """``contains_any`` on a named column, as SQL text."""
    tests = " OR ".join(f"contains(`{name}`, {sql_string(n)})" for n in needles)
    return f"coalesce({tests}, false)" if tests else "false"


def contains_word_sql(name: str, phrases: Sequence[str]) -> str:
    """``contains_word`` on a named column, as SQL text."""
    padded = f"concat(' ', coalesce(`{name}`, ''), ' ')"
    return f"({contains_any_sql(name, phrases)} AND {padded} RLIKE {sql_string(word_pattern(phrases))})"


def contains_any(c: Column | str, needles: Iterable[str]) -> Column:
    """Any needle is a substring; null text does not match."""
    if isinstance(c, str):
        return F.expr(contains_any_sql(c, needles))
    tests = [F.contains(_col(c), F.lit(n)) for n in needles]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def word_pattern(phrases: Sequence[str]) -> str:
    return f"{NOT_WORD}(?:{'|'.join(escape_regex(p) for p in phrases)}){NOT_WORD}"


def contains_word(c: Column | str, phrases: Sequence[str]) -> Column:
    """Any phrase occurs with no word character next to it on either side.

    The text is padded with spaces so that its ends count as boundaries. One
    literal pattern per rule, so it is compiled once; it only runs on texts that
    pass the far cheaper substring test.
    """
    if isinstance(c, str):
        return F.expr(contains_word_sql(c, phrases))
    padded = F.concat(F.lit(" "), text_or_empty(c), F.lit(" "))
    return contains_any(c, phrases) & padded.rlike(word_pattern(phrases))


# --- tokens ----------------------------------------------------------------

def tokenize(c: Column | str, pattern: str = ANY_WORD) -> Column:
    """lower-cased matches of ``pattern`` in reading order."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(pattern), F.lit(0))


def remove_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """drop listed tokens, keep the order of the rest."""
    if not stop_words:
        return tokens
    listed = [w for w in stop_words]
    return F.filter(tokens, lambda t: ~t.isin(listed))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """all word n-grams for n from ``low`` to ``high``, joined by a space."""

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        shorter = of_size(t, n - 1)
        # Each gram is the one word shorter gram at its place and the word after it.
        grams = F.zip_with(
            F.slice(shorter, 1, F.size(t) - (n - 1)), F.slice(t, n, F.size(t)), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*[of_size(t, n) for n in range(low, high + 1)]))

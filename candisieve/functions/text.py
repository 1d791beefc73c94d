"""Text expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks a word boundary inside a text prepared by ``mark_bounds``.
BOUND = "\u0001"

# ASCII punctuation, as a character class body.
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""


# White space of every script, as character class bodies: all kinds but the blank, and all.
NOT_BLANK = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same, one by one.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(_col(c), F.lit(SPACES))


def not_blank(c) -> Column:
    """Whether something is left after ``strip``; ends at the first such character, however long the text."""
    return F.rlike(_col(c), F.lit(f"[^{SPACE}]"))


def squash(c) -> Column:
    """Runs of white space of any kind as one blank.

    A plain class turns the rare kinds into blanks; runs are sought only where some remain.
    """
    flat = F.regexp_replace(_col(c), f"[{NOT_BLANK}]", " ")
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def norm_raw(c) -> Column:
    """White space collapsed and trimmed, case kept, null becomes ''."""
    return F.trim(squash(F.coalesce(_col(c), F.lit(""))))


def norm_text(c) -> Column:
    """``norm_raw`` in lower case."""
    return F.lower(norm_raw(c))


def norm_list(c) -> Column:
    """Normalised items, empty ones dropped, first occurrence kept."""
    items = F.transform(F.coalesce(_col(c), no_strings()), norm_text)
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def lower_strip(c) -> Column:
    return F.lower(strip(c))


def clean_skill(c) -> Column:
    """Dashes become spaces, white space collapses, lower case."""
    return norm_text(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("-"), F.lit(" ")))


def strip_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def mark_bounds(c) -> Column:
    """Put ``BOUND`` at every word boundary.

    Prepared once per text, a word-bounded search for any literal then is a plain
    ``contains`` (see ``bounded_in``) and needs no regex per pair.
    """
    return F.regexp_replace(_col(c), r"(?U)\b", BOUND)


def mark_literal(c) -> Column:
    """A search literal prepared for ``bounded_in``: marked, with both ends bounded."""
    inner = F.regexp_replace(mark_bounds(c), f"^{BOUND}|{BOUND}$", "")
    return F.when(inner == "", F.lit(BOUND)).otherwise(F.concat(F.lit(BOUND), inner, F.lit(BOUND)))


def mark_word(c) -> Column:
    """As ``mark_literal``, but an end is bounded only where it is a letter or digit."""
    inner = F.regexp_replace(mark_bounds(c), f"^{BOUND}|{BOUND}$", "")
    return F.concat(
        F.when(inner.rlike(r"^[\p{L}\p{N}]"), BOUND).otherwise(""), inner,
        F.when(inner.rlike(r"[\p{L}\p{N}]$"), BOUND).otherwise(""))


def bounded_in(marked_literal: Column, marked_text: Column) -> Column:
    """Is the literal in the text between word boundaries?"""
    return F.contains(marked_text, marked_literal)


def py_mark_literal(text: str) -> str:
    """``mark_literal`` of a constant."""
    return BOUND + re.sub(r"\b", BOUND, text).strip(BOUND) + BOUND


def any_of(words: Iterable[str]) -> str:
    """An alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Does the text hold one of the constant words as a substring?"""
    return c.rlike(any_of(words))


def sql_value(value) -> str:
    """A constant as SQL text: strings, numbers, lists and dictionaries of them.

    Constant tables go to Spark as one SQL literal each, which the optimiser folds.
    """
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return "'" + escaped + "'"
    if isinstance(value, Mapping):
        return "map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_value(v) for v in value) + ")"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def constant(value) -> Column:
    return F.expr(sql_value(value))


def records(rows: Iterable[Mapping]) -> Column:
    """A constant array of structs."""
    items = ("struct(" + ", ".join(f"{sql_value(v)} AS {k}" for k, v in row.items()) + ")" for row in rows)
    return F.expr("array(" + ", ".join(items) + ")")


def word_list(words: Iterable[str]) -> Column:
    return constant(list(words))


def in_words(c: Column, words: Iterable[str]) -> Column:
    return F.array_contains(word_list(words), c)


def lookup(c: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Constant dictionary lookup as one map literal."""
    found = F.try_element_at(constant(table), c)
    return F.coalesce(found, c if default is None else default)


def list_lookup(c: Column, table: Mapping[str, list[str]]) -> Column:
    """Constant dictionary of string lists; a missing key gives an empty list."""
    return F.coalesce(F.try_element_at(constant(table), c), no_strings())


def no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also when ``use`` reads it
    inside lambdas (which evaluate what they capture for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reverse_aliases(table: Mapping[str, list[str]]) -> dict[str, str]:
    return {alias: name for name, aliases in table.items() for alias in aliases}


def word_tokens(c: Column) -> Column:
    """Maximal runs of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def term_tokens(c: Column) -> Column:
    r"""Tokens of ``\b[a-z0-9./-]+\b``: runs of the class that begin and end at a boundary."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\b([a-z0-9\.\-/]+)\b"), F.lit(1))


def try_date(c: Column) -> Column:
    """Dates with one or two digit months and days; anything else gives null."""
    return F.try_to_date(c, "yyyy-M-d")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))

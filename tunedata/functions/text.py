"""Column expressions shared by the operators.

All helpers return ``pyspark.sql.Column`` built from native functions, so
they stay inside whole-stage codegen (or, for the higher-order functions, in
the JVM) and never start a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.strip()`` removes every character for which ``isspace()`` is
# true; Spark's ``trim`` removes only the blank. The set is derived from that
# rule rather than typed out (all such characters lie below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# FIXED VALUES: token and sentence patterns. Both give identical matches in
# Java regex (Spark) and RE2 (DuckDB).
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
SENTENCE_PATTERN = r"[^.\n]*[.\n]+|[^.\n]+$"
FIRST_SENTENCE_PATTERN = r"^(?:[^.\n]*[.\n]+|[^.\n]+$)"
NUMBER_PATTERN = r"[0-9]+"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``str.strip()``: drop leading/trailing whitespace, keep inner text."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def normalize_newlines(c: Column | str) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n`` (what Python text mode does)."""
    return F.regexp_replace(col_(c), r"\r\n?", "\n")


def tokens(c: Column | str) -> Column:
    """Word / punctuation tokens of a text (array<string>, empty for '')."""
    return F.regexp_extract_all(col_(c), F.lit(TOKEN_PATTERN), 0)


def first_sentence(c: Column | str) -> Column:
    """``sentences(c)[0]`` without splitting the whole text ('' if empty): the
    first sentence match of a non-empty text always starts at position 0."""
    return F.regexp_extract(col_(c), FIRST_SENTENCE_PATTERN, 0)


def sentences(c: Column | str) -> Column:
    """Lossless split into sentences: ``array_join(sentences(t), '') == t``."""
    return F.regexp_extract_all(col_(c), F.lit(SENTENCE_PATTERN), 0)


def seeded_key(seed: int | str, key: Column | str) -> Column:
    """Engine-independent pseudo-random order key: md5('<seed>:<key>')."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string")))


def concat_lit(*parts) -> Column:
    """``concat`` where plain ``str`` parts are literals (never a format or
    a regex replacement, so ``{}``, ``%s``, ``$1`` and backslashes in the data
    are copied as they are)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def python_list_repr(arr: Column | str) -> Column:
    """``str(list_of_str)`` for plain strings: ``['a', 'b']``."""
    quoted = F.transform(col_(arr), lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

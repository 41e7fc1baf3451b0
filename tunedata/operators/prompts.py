"""Projections, filters and prompt rendering (all narrow, codegen'd).

Templates are applied with ``concat(prefix, text, suffix)`` chosen by a
``CASE`` on the kind: no join, no format string, no regex replacement, so
``{question}``, ``%s``, ``$1`` and backslashes in the data are copied as is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.functions.text import col_, concat_lit, python_list_repr, strip


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    expr = None
    for k, v in values.items():
        expr = F.when(kind == k, v) if expr is None else expr.when(kind == k, v)
    return expr  # unknown kind -> NULL


def render(text: Column | str, kind: Column | str, templates: dict[str, str]) -> Column:
    """Fill the ``{question}`` slot of the template chosen by ``kind``."""
    text, kind = col_(text), col_(kind)
    parts = {k: T.split_template(t) for k, t in templates.items()}
    return _by_kind(kind, {k: concat_lit(p, text, s) for k, (p, s) in parts.items()})


def unrender(prompt: Column | str, kind: Column | str, templates: dict[str, str]) -> Column:
    """Inverse of ``render``: the slot text, or NULL if the prompt does not
    have the template's prefix and suffix."""
    prompt, kind = col_(prompt), col_(kind)
    out = {}
    for k, t in templates.items():
        p, s = T.split_template(t)
        n = F.length(prompt) - F.lit(len(p) + len(s))
        ok = prompt.startswith(p) & prompt.endswith(s) & (n >= 0)
        out[k] = F.when(ok, F.substr(prompt, F.lit(len(p) + 1), n))
    return _by_kind(kind, out)


# --- P1 ----------------------------------------------------------------------
def strip_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, strip(column))


# --- P4 ----------------------------------------------------------------------
def expand_variants(df: DataFrame, kinds=T.KINDS, kind_col: str = "kind") -> DataFrame:
    """One row per (row, kind): explode of a literal array, no join."""
    return df.withColumn(kind_col, F.explode(F.array(*[F.lit(k) for k in kinds])))


# --- P2 / P3 -----------------------------------------------------------------
def rewrite_prompt(df: DataFrame, text: str = "text", kind: str = "kind",
                   out: str = "prompt") -> DataFrame:
    return df.withColumn(out, render(text, kind, T.REWRITE_TEMPLATES))


def question_prompt(df: DataFrame, text: str = "text", kind: str = "kind",
                    out: str = "prompt") -> DataFrame:
    return df.withColumn(out, render(text, kind, T.QUESTION_TEMPLATES))


# --- P5 ----------------------------------------------------------------------
def paired_prompt(variants: DataFrame, originals: DataFrame, key: str = "problem_id",
                  variant_text: str = "text", original_text: str = "text",
                  kind: str = "kind", out: str = "prompt") -> DataFrame:
    """Original + variant of the same problem in one prompt (equi-join on key)."""
    o = originals.select(F.col(key), F.col(original_text).alias("_orig"))
    v = variants.join(o, key)
    vals = {}
    for k, t in T.PAIRED_TEMPLATES.items():
        head, rest = t.split("{original}")
        mid, tail = rest.split("{variant}")
        vals[k] = concat_lit(head, F.col("_orig"), mid, F.col(variant_text), tail)
    return v.withColumn(out, _by_kind(F.col(kind), vals)).drop("_orig")


# --- P6 ----------------------------------------------------------------------
def unrender_prompt(df: DataFrame, templates: dict[str, str] = T.QUESTION_TEMPLATES,
                    kind: str = "kind") -> DataFrame:
    """Generation pair (input, output) -> training pair (problem, answer)."""
    return (df.withColumn("problem", unrender("input", kind, templates))
            .withColumnRenamed("output", "answer").drop("input"))


# --- P7 ----------------------------------------------------------------------
def tag_type_lines(lines: DataFrame, value: str, line: str = "value") -> Column:
    """Type of a raw JSON line: the line's ``type`` if the key is present
    (even if null), else ``value``; NULL for a corrupt line."""
    has = F.array_contains(F.json_object_keys(F.col(line)), "type")
    return F.when(has, F.get_json_object(F.col(line), "$.type")).when(~has, F.lit(value))


def tag_type(df: DataFrame, value: str, column: str = "type") -> DataFrame:
    """For typed tables, where missing and null cannot be told apart."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def normalize_type(df: DataFrame, column: str = "type") -> DataFrame:
    """``ambiguous`` -> ``Ambiguous`` on ingest (only 'Original' is compared)."""
    return df.withColumn(column, F.initcap(column))


# --- P8 ----------------------------------------------------------------------
def keep_complete(df: DataFrame, problem: str = "problem", answer: str = "answer") -> DataFrame:
    return df.where(F.col(problem).isNotNull() & F.col(answer).isNotNull())


# --- P9 / P10 / P11 / P12 ----------------------------------------------------
def concat_v1(problem="problem", answer="answer") -> Column:
    return F.concat(col_(problem), col_(answer))


def concat_v3(problem="problem", answer="answer", type_="type") -> Column:
    return F.concat(col_(problem), col_(answer), col_(type_))


def v4_answer_prompt(type_="type") -> Column:
    return F.when(col_(type_) == T.ORIGINAL, F.lit(T.V4_ANSWER_PROMPT_ORIGINAL)).otherwise(
        F.lit(T.V4_ANSWER_PROMPT_OTHER))


def concat_v4(problem="problem", answer="answer", type_="type") -> Column:
    return F.concat(F.lit(T.V4_QUESTION_PROMPT + " "), col_(problem),
                    v4_answer_prompt(type_), F.lit(" "), col_(answer))


def concat_profile(problem="problem", answer="answer") -> Column:
    return F.concat_ws(" ", F.coalesce(col_(problem), F.lit("")),
                       F.coalesce(col_(answer), F.lit("")))


# --- P13 / P14 / P15 / P16 ---------------------------------------------------
def preference_prompt(problem="problem") -> Column:
    return concat_lit(T.PREFERENCE_PROMPT_PREFIX, col_(problem), T.PREFERENCE_PROMPT_SUFFIX)


def rejection_prompt(answer="answer", type_="type") -> Column:
    head = F.when(col_(type_) == T.ORIGINAL, F.lit(T.REJECTION_PROMPT_ORIGINAL)).otherwise(
        F.lit(T.REJECTION_PROMPT_OTHER))
    return F.concat(head, col_(answer))


def strip_prompt_echo(generated="generated", prompt="prompt") -> Column:
    """Drop the first ``length(prompt)`` characters, then strip (no prefix check)."""
    return strip(F.substr(col_(generated), F.length(col_(prompt)) + 1))


def merge_tags(text="quote", tags="tags") -> Column:
    return F.concat(col_(text), F.lit(T.TAG_SEPARATOR), python_list_repr(tags))


# --- P17 ---------------------------------------------------------------------
def head_n(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """First ``n`` rows by ``order`` (top-k; ``None`` keeps all)."""
    return df if n is None else df.orderBy(order).limit(n)

"""Small helpers to write the DuckDB oracle SQL from the same constants."""

from __future__ import annotations

from tunedata.functions import templates as T
from tunedata.functions.text import TOKEN_PATTERN, WHITESPACE, SENTENCE_PATTERN


def lit(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes and newlines as they are)."""
    return "'" + s.replace("'", "''") + "'"


PAT = lit(TOKEN_PATTERN)
SENT = lit(SENTENCE_PATTERN)
WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, {PAT}, 0)"


def render(text: str, kind: str, templates: dict[str, str]) -> str:
    arms = []
    for k, t in templates.items():
        p, s = T.split_template(t)
        arms.append(f"WHEN {kind} = {lit(k)} THEN {lit(p)} || {text} || {lit(s)}")
    return "CASE " + " ".join(arms) + " END"


def seeded(seed, key: str) -> str:
    return f"md5({lit(f'{seed}:')} || CAST({key} AS VARCHAR))"


def sents(x: str) -> str:
    return f"regexp_extract_all({x}, {SENT}, 0)"


def rule_variant(kind: str, text: str) -> str:
    """SQL twin of ``generate.rule_variant`` (stripped, as the backend returns)."""
    from tunedata.operators.generate import NEGATION_LEAD
    s = sents(text)
    n = f"len({s})"
    keep = f"{n} - least({n} - 1, greatest(1, CAST(floor({n} / 3) AS BIGINT)))"
    body = (f"CASE {kind} WHEN 'ambiguous' THEN regexp_replace({text}, '[0-9]+', 'some', 'g') "
            f"WHEN 'inconsistent' THEN {text} || chr(10) || {lit(NEGATION_LEAD)} || "
            f"coalesce({strip(f'{s}[1]')}, '') "
            f"WHEN 'incomplete' THEN array_to_string({s}[1:{keep}], '') END")
    return strip(body)


def rule_questions(kind: str, text: str) -> str:
    """SQL twin of ``generate.rule_questions`` over ``sentences(text)``."""
    from tunedata.operators.generate import QUESTION_FORMS
    qs = (f"list_filter(list_transform({sents(text)}, lambda s: "
          f"regexp_replace({strip('s')}, '[.]+$', '')), lambda s: s <> '')")
    arms = " ".join(f"WHEN {lit(k)} THEN {lit('. ' + pre)} || s || {lit(post)}"
                    for k, (pre, post) in QUESTION_FORMS.items())
    return (f"array_to_string(list_transform({qs}, lambda s, i: CAST(i AS VARCHAR) || "
            f"CASE {kind} {arms} END), chr(10))")


def rules_response(stage: str, kind: str, text: str) -> str:
    """SQL twin of ``generate.rules_backend``."""
    rk = f"(CASE WHEN {kind} = 'original' THEN 'ambiguous' ELSE 'inconsistent' END)"
    return (f"CASE {stage} WHEN 'rewrite' THEN {rule_variant(kind, text)} "
            f"WHEN 'question' THEN {rule_questions(kind, text)} "
            f"WHEN 'reject' THEN CASE WHEN {kind} = 'original' THEN {rule_questions(rk, text)} "
            f"ELSE {rule_variant(rk, text)} END END")


def hash_rank(seed, key: str, by: str | None = None) -> str:
    """SQL twin of ``rank.hash_rank`` (row_number over the seeded md5 order)."""
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {seeded(seed, key)}, {key})"


def request_id(stage: str, kind: str, prompt: str) -> str:
    return f"sha256(concat_ws(chr(1), {stage}, {kind}, {lit(T.GENERATION_PARAMS)}, {prompt}))"


KINDS = "[" + ", ".join(lit(k) for k in T.KINDS) + "]"

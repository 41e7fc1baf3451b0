"""Registered queries (one per operator key) and their DuckDB oracles.

Every query reads the driver's tables (through ``sources.views``) and runs
over whole tables and whole texts. ``QUERIES[key](spark, sf_dir)`` returns a
DataFrame; ``ORACLE[key]`` is the equivalent DuckDB SQL over the same
parquet views (absent for operators that are not SQL-expressible).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.operators import anchors as AN
from tunedata.operators import kneser_ney as KN
from tunedata.operators import metrics as M
from tunedata.operators import prompts as P
from tunedata.operators import subword as SW
from tunedata.operators import tokens as TK
from tunedata.plans import sql as S
from tunedata.sources import folders as FO
from tunedata.sources import variant as VA
from tunedata.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = V.with_views(sql, *views)
        return fn
    return deco


# ---------------------------------------------------------------------------
# P9-P12, T1, M1-M4, M7 (minimum slice first)
# ---------------------------------------------------------------------------
V4_SQL = (f"{S.lit(T.V4_QUESTION_PROMPT + ' ')} || problem || CASE WHEN type = 'Original' "
          f"THEN {S.lit(T.V4_ANSWER_PROMPT_ORIGINAL)} ELSE {S.lit(T.V4_ANSWER_PROMPT_OTHER)} END"
          " || ' ' || answer")


@register("concat_v1", "SELECT record_id, problem || answer AS text FROM records", ("records",))
def q_concat_v1(spark, sf):
    return V.records(spark, sf).select("record_id", P.concat_v1().alias("text"))


@register("concat_v3", "SELECT record_id, problem || answer || type AS text FROM records",
          ("records",))
def q_concat_v3(spark, sf):
    return V.records(spark, sf).select("record_id", P.concat_v3().alias("text"))


@register("concat_v4", f"SELECT record_id, {V4_SQL} AS text FROM records", ("records",))
def q_concat_v4(spark, sf):
    return V.records(spark, sf).select("record_id", P.concat_v4().alias("text"))


@register("tokenize", f"SELECT doc_id, {S.toks('text')} AS tokens FROM problems", ("problems",))
def q_tokenize(spark, sf):
    return V.problems(spark, sf).select("doc_id", TK.tokenize("text").alias("tokens"))


_PROFILE_N = ("len(" + S.toks("concat_ws(' ', coalesce(problem, ''), coalesce(answer, ''))")
              + ")")


@register("token_length_stats", f"""
SELECT count(*) AS records, round(avg(n), 6) AS avg_tokens, max(n) AS max_tokens,
       min(n) AS min_tokens
FROM (SELECT {_PROFILE_N} AS n FROM records) t HAVING count(*) > 0""", ("records",))
def q_token_length_stats(spark, sf):
    return M.token_length_stats(V.records(spark, sf))


@register("truncation_report", f"""
SELECT count(*) AS records,
       CAST(sum(CASE WHEN n > 512 THEN 1 ELSE 0 END) AS BIGINT) AS over_512,
       round(avg(CASE WHEN n > 512 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS share_over_512,
       CAST(sum(CASE WHEN n > 2048 THEN 1 ELSE 0 END) AS BIGINT) AS over_2048,
       round(avg(CASE WHEN n > 2048 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS share_over_2048
FROM (SELECT {_PROFILE_N} AS n FROM (SELECT text AS problem, CAST(NULL AS VARCHAR) AS answer
                                   FROM documents) d) t HAVING count(*) > 0""")
def q_truncation_report(spark, sf):
    docs = V.problems(spark, sf).select(F.col("text").alias("problem"),
                                        F.lit(None).cast("string").alias("answer"))
    return M.truncation_report(docs)



_ENTROPY_SQL = f"""
ent_t AS (SELECT doc_id, unnest({S.toks('lower(text)')}) AS tok FROM problems),
ent_c AS (SELECT doc_id, count(*) AS n FROM ent_t GROUP BY doc_id, tok),
ent_s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS tot FROM ent_c),
ent AS (SELECT doc_id, -sum(n / tot * ln(n / tot + 1e-10)) AS h FROM ent_s GROUP BY doc_id)"""


@register("entropy", f"""
WITH {_ENTROPY_SQL}
SELECT p.doc_id, round(coalesce(ent.h, 0.0), 4) AS entropy
FROM problems p LEFT JOIN ent ON p.doc_id = ent.doc_id""", ("problems",))
def q_entropy(spark, sf):
    e = M.with_entropy(V.problems(spark, sf), "text")
    return e.select("doc_id", F.round("entropy", 4).alias("entropy"))


def perplexity_sql(table: str, key: str, text: str, out: str, limit: int = 1024) -> str:
    """CTE chain ending in ``{out}_res(key, out)`` (unrounded)."""
    return f"""
{out}_t AS (SELECT {key} AS k, {S.toks(f'lower({text})')}[1:{limit}] AS toks FROM {table}),
{out}_pr AS (SELECT k, unnest(list_transform(toks, lambda w, i:
        {{'p': CASE WHEN i = 1 THEN '<s>' ELSE toks[i - 1] END, 'w': w}})) AS pw FROM {out}_t),
{out}_pw AS (SELECT k, pw.p AS p, pw.w AS w FROM {out}_pr),
{out}_c AS (SELECT p, w, count(*) AS c FROM {out}_pw GROUP BY p, w),
{out}_cp AS (SELECT p, sum(c) AS cp FROM {out}_c GROUP BY p),
{out}_v AS (SELECT count(DISTINCT w) AS v FROM {out}_c),
{out}_s AS (SELECT x.k, -ln((c.c + 1) / (cp.cp + v.v)) AS nll
            FROM {out}_pw x JOIN {out}_c c ON x.p = c.p AND x.w = c.w
            JOIN {out}_cp cp ON x.p = cp.p CROSS JOIN {out}_v v),
{out}_res AS (SELECT k, exp(avg(nll)) AS {out} FROM {out}_s GROUP BY k
              UNION ALL SELECT k, NULL FROM {out}_t WHERE len(toks) = 0)"""


@register("perplexity", f"""
WITH {perplexity_sql('problems', 'doc_id', 'text', 'perplexity')}
SELECT k AS doc_id, round(perplexity, 4) AS perplexity FROM perplexity_res""", ("problems",))
def q_perplexity(spark, sf):
    p = M.perplexity(V.problems(spark, sf), "doc_id", "text")
    return p.select("doc_id", F.round("perplexity", 4).alias("perplexity"))


_KN_MODEL = f"""
kn_t AS (SELECT doc_id, list_concat(['<s>', '<s>'], {S.toks('lower(text)')}) AS t
         FROM documents WHERE text IS NOT NULL),
kn_g AS (SELECT unnest(list_transform(range(3, len(t) + 1), lambda i:
             {{'u': t[i - 2], 'v': t[i - 1], 'w': t[i]}})) AS g FROM kn_t),
kn_3 AS (SELECT g.u AS u, g.v AS v, g.w AS w, count(*) AS c FROM kn_g GROUP BY 1, 2, 3),
kn_b3 AS (SELECT u, v, sum(c) AS total, count(*) AS types FROM kn_3 GROUP BY u, v),
kn_2 AS (SELECT v, w, count(*) AS c FROM kn_3 GROUP BY v, w),
kn_b2 AS (SELECT v, sum(c) AS total, count(*) AS types FROM kn_2 GROUP BY v),
kn_1 AS (SELECT w, count(*) AS c FROM kn_2 GROUP BY w),
kn_d AS (SELECT (SELECT count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) FROM kn_1) AS d1,
                (SELECT count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) FROM kn_2) AS d2,
                (SELECT count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) FROM kn_3) AS d3,
                (SELECT sum(c) FROM kn_1) AS total, (SELECT count(*) FROM kn_1) AS words)"""


@register("perplexity_kn", f"""
WITH {_KN_MODEL},
q_t AS (SELECT record_id, list_concat(['<s>', '<s>'], {S.toks("lower(problem || ' ' || answer)")}) AS t FROM records),
q_g AS (SELECT record_id, unnest(list_transform(range(3, len(t) + 1), lambda i:
            {{'u': t[i - 2], 'v': t[i - 1], 'w': t[i]}})) AS g FROM q_t),
q_1 AS (SELECT record_id, g.u AS u, g.v AS v, g.w AS w,
               greatest(coalesce(kn_1.c, 0) - d1, 0) / kn_d.total + d1 * words / kn_d.total / (words + 1) AS p1,
               d2, d3
        FROM q_g LEFT JOIN kn_1 ON kn_1.w = g.w CROSS JOIN kn_d),
q_2 AS (SELECT q_1.*, CASE WHEN b.total IS NULL THEN p1 ELSE greatest(coalesce(c.c, 0) - d2, 0) / b.total
                      + d2 * b.types / b.total * p1 END AS p2
        FROM q_1 LEFT JOIN kn_b2 b ON b.v = q_1.v LEFT JOIN kn_2 c ON c.v = q_1.v AND c.w = q_1.w),
q_3 AS (SELECT record_id, CASE WHEN b.total IS NULL THEN p2 ELSE greatest(coalesce(c.c, 0) - d3, 0) / b.total
                          + d3 * b.types / b.total * p2 END AS p3
        FROM q_2 LEFT JOIN kn_b3 b ON b.u = q_2.u AND b.v = q_2.v
        LEFT JOIN kn_3 c ON c.u = q_2.u AND c.v = q_2.v AND c.w = q_2.w)
SELECT r.record_id, round(x.perplexity, 4) AS perplexity
FROM records r LEFT JOIN (SELECT record_id, exp(avg(-ln(p3))) AS perplexity FROM q_3 GROUP BY record_id) x
ON r.record_id = x.record_id""", ("records",))
def q_perplexity_kn(spark, sf):
    """Records by a model of all documents."""
    model = KN.train(KN.text_trigrams(V.problems(spark, sf), "doc_id", "text", hashed=True))
    texts = V.records(spark, sf).select("record_id", F.concat_ws(" ", "problem", "answer").alias("text"))
    p = KN.perplexity_kn(texts, "record_id", "text", model)
    return p.select("record_id", F.round("perplexity", 4).alias("perplexity"))


@register("type_counts", "SELECT type, count(*) AS n FROM records GROUP BY type", ("records",))
def q_type_counts(spark, sf):
    return M.type_counts(V.records(spark, sf))


# ---------------------------------------------------------------------------
# Prompts and projections
# ---------------------------------------------------------------------------
from tunedata.operators import generate as G  # noqa: E402

_STRIPPED = f"SELECT doc_id, {S.strip('text')} AS text FROM problems"


def _stripped(spark, sf):
    return P.strip_text(V.problems(spark, sf))


@register("strip_text", _STRIPPED, ("problems",))
def q_strip_text(spark, sf):
    return _stripped(spark, sf)


@register("expand_variants", f"SELECT doc_id, unnest({S.KINDS}) AS kind FROM problems",
          ("problems",))
def q_expand_variants(spark, sf):
    return P.expand_variants(V.problems(spark, sf).select("doc_id"))


_REWRITE = (f"SELECT doc_id, kind, text, {S.render('text', 'kind', T.REWRITE_TEMPLATES)} AS prompt "
            f"FROM (SELECT doc_id, unnest({S.KINDS}) AS kind, text FROM ({_STRIPPED}) s) e")


def _rewrite(spark, sf):
    return P.rewrite_prompt(P.expand_variants(_stripped(spark, sf)))


@register("rewrite_prompt", f"SELECT doc_id, kind, prompt FROM ({_REWRITE}) r", ("problems",))
def q_rewrite_prompt(spark, sf):
    return _rewrite(spark, sf).select("doc_id", "kind", "prompt")


_QUESTION = (f"SELECT doc_id, kind, text, {S.render('text', 'kind', T.QUESTION_TEMPLATES)} "
             f"AS prompt FROM (SELECT doc_id, unnest({S.KINDS}) AS kind, text "
             f"FROM ({_STRIPPED}) s) e")


def _question(spark, sf):
    return P.question_prompt(P.expand_variants(_stripped(spark, sf)))


@register("question_prompt", f"SELECT doc_id, kind, prompt FROM ({_QUESTION}) q", ("problems",))
def q_question_prompt(spark, sf):
    return _question(spark, sf).select("doc_id", "kind", "prompt")


@register("unrender_prompt", f"SELECT doc_id, kind, text AS problem FROM ({_QUESTION}) q",
          ("problems",))
def q_unrender_prompt(spark, sf):
    q = _question(spark, sf).select("doc_id", "kind", F.col("prompt").alias("input"),
                                    F.lit("").alias("output"))
    return P.unrender_prompt(q).select("doc_id", "kind", "problem")


# --- P6 without a given template ---------------------------------------------
_ALL_TEMPLATES = [("rewrite", k, *T.split_template(t)) for k, t in T.REWRITE_TEMPLATES.items()] + [
    ("question", k, *T.split_template(t)) for k, t in T.QUESTION_TEMPLATES.items()]


def _all_prompts(spark, sf):
    e = P.expand_variants(_stripped(spark, sf))
    r = P.rewrite_prompt(e).withColumn("stage", F.lit("rewrite"))
    return r.unionByName(P.question_prompt(e).withColumn("stage", F.lit("question")))


@register("learn_templates", f"""
WITH n AS (SELECT count(DISTINCT text) AS prompts FROM ({_STRIPPED}) s)
SELECT prefix, suffix, prompts FROM n, (VALUES {", ".join(
    f"({S.lit(a)}, {S.lit(b)})" for _, _, a, b in _ALL_TEMPLATES)}) t(prefix, suffix)""", ("problems",))
def q_learn_templates(spark, sf):
    return AN.learn_templates(_all_prompts(spark, sf))


@register("learned_slots", f"""
SELECT doc_id, stage, kind, text AS slot FROM ({_STRIPPED}) s,
       (VALUES {", ".join(f"({S.lit(a)}, {S.lit(b)})" for a, b, _, _ in _ALL_TEMPLATES)}) t(stage, kind)""", ("problems",))
def q_learned_slots(spark, sf):
    prompts = _all_prompts(spark, sf)
    return AN.slots(prompts, AN.learn_templates(prompts)).select("doc_id", "stage", "kind", "slot")


_VARIANTS = (f"SELECT doc_id, kind, {S.rule_variant('kind', 'text')} AS variant "
             f"FROM (SELECT doc_id, unnest({S.KINDS}) AS kind, text FROM ({_STRIPPED}) s) e")


def _variants(spark, sf):
    e = P.expand_variants(_stripped(spark, sf))
    e = e.withColumn("_sents", G.sentences("text"))
    v = G.rule_variant(F.col("kind"), F.col("text"), F.col("_sents"))
    return e.select("doc_id", "kind", G.strip(v).alias("variant"))


@register("rule_variants", _VARIANTS, ("problems",))
def q_rule_variants(spark, sf):
    return _variants(spark, sf)


def _pair_sql() -> str:
    arms = []
    for k, t in T.PAIRED_TEMPLATES.items():
        head, rest = t.split("{original}")
        mid, tail = rest.split("{variant}")
        arms.append(f"WHEN {S.lit(k)} THEN {S.lit(head)} || o.text || {S.lit(mid)} || "
                    f"v.variant || {S.lit(tail)}")
    return "CASE v.kind " + " ".join(arms) + " END"


@register("paired_prompt", f"""
SELECT v.doc_id, v.kind, {_pair_sql()} AS prompt
FROM ({_VARIANTS}) v JOIN ({_STRIPPED}) o ON v.doc_id = o.doc_id""", ("problems",))
def q_paired_prompt(spark, sf):
    v = _variants(spark, sf).withColumnRenamed("doc_id", "problem_id")
    o = _stripped(spark, sf).withColumnRenamed("doc_id", "problem_id")
    out = P.paired_prompt(v, o, variant_text="variant")
    return out.select(F.col("problem_id").alias("doc_id"), "kind", "prompt")


@register("rule_questions", f"""
SELECT doc_id, kind, {S.rule_questions('kind', 'text')} AS questions
FROM (SELECT doc_id, unnest({S.KINDS}) AS kind, text FROM ({_STRIPPED}) s) e""", ("problems",))
def q_rule_questions(spark, sf):
    e = P.expand_variants(_stripped(spark, sf)).withColumn("_sents", G.sentences("text"))
    e = e.withColumn("_qs", G.question_sentences(F.col("_sents")))
    return e.select("doc_id", "kind", G.rule_questions(F.col("kind"), "_qs").alias("questions"))


_TAG_LINES = """
SELECT record_id, problem, answer,
       CASE record_id % 3 WHEN 0 THEN type WHEN 1 THEN 'Incomplete' ELSE NULL END AS type
FROM records"""


@register("tag_type", _TAG_LINES, ("records",))
def q_tag_type(spark, sf):
    """Raw JSON lines where ``type`` is present, missing or explicitly null;
    only the missing one is filled (read back from the shared folder)."""
    from tunedata.session import scratch_path
    r = V.records(spark, sf)
    m = F.col("record_id") % 3
    with_t = F.to_json(F.struct("record_id", "problem", "answer", "type"))
    without = F.to_json(F.struct("record_id", "problem", "answer"))
    null_t = F.to_json(F.struct("record_id", "problem", "answer",
                                F.lit(None).cast("string").alias("type")),
                       {"ignoreNullFields": "false"})
    lines = r.select(F.when(m == 0, with_t).when(m == 1, without).otherwise(null_t)
                     .alias("value"))
    path = scratch_path(spark, "tag-type")
    lines.write.mode("overwrite").text(path)
    raw = spark.read.text(path)
    schema = "record_id BIGINT, problem STRING, answer STRING"
    parsed = raw.select(F.from_json("value", schema).alias("j"),
                        P.tag_type_lines(raw, "Incomplete").alias("type"))
    return parsed.select("j.record_id", "j.problem", "j.answer", "type")


@register("keep_complete", "SELECT record_id, problem, answer FROM records", ("records",))
def q_keep_complete(spark, sf):
    r = V.records(spark, sf).select("record_id", "problem", "answer")
    o = V.requests_open(spark, sf).select("record_id", F.col("input").alias("problem"),
                                          F.lit(None).cast("string").alias("answer"))
    return P.keep_complete(r.unionByName(o))


_REJECT_SQL = (f"CASE WHEN type = 'Original' THEN {S.lit(T.REJECTION_PROMPT_ORIGINAL)} "
               f"ELSE {S.lit(T.REJECTION_PROMPT_OTHER)} END || answer")


@register("rejection_prompt", f"SELECT record_id, {_REJECT_SQL} AS prompt FROM records",
          ("records",))
def q_rejection_prompt(spark, sf):
    return V.records(spark, sf).select("record_id", P.rejection_prompt().alias("prompt"))


@register("preference_prompt", f"""
SELECT record_id, {S.lit(T.PREFERENCE_PROMPT_PREFIX)} || problem ||
       {S.lit(T.PREFERENCE_PROMPT_SUFFIX)} AS prompt FROM records""", ("records",))
def q_preference_prompt(spark, sf):
    return V.records(spark, sf).select("record_id", P.preference_prompt().alias("prompt"))


@register("strip_prompt_echo", f"""
SELECT record_id, {S.strip('substring(problem || answer, length(problem) + 1)')} AS response
FROM records""", ("records",))
def q_strip_prompt_echo(spark, sf):
    r = V.records(spark, sf).select("record_id", F.col("problem").alias("prompt"),
                                    P.concat_v1().alias("generated"))
    return r.select("record_id", P.strip_prompt_echo().alias("response"))


@register("merge_tags", f"""
SELECT doc_id, text || {S.lit(T.TAG_SEPARATOR)} || '[' ||
       array_to_string(list_transform([lang, source], lambda t: '''' || t || ''''), ', ')
       || ']' AS prediction FROM documents""")
def q_merge_tags(spark, sf):
    d = V.table(spark, sf, "documents")
    d = d.select("doc_id", F.col("text").alias("quote"), F.array("lang", "source").alias("tags"))
    return d.select("doc_id", P.merge_tags().alias("prediction"))


@register("head_n", "SELECT record_id, problem, answer, type FROM records "
          "ORDER BY record_id LIMIT 5", ("records",))
def q_head_n(spark, sf):
    return P.head_n(V.records(spark, sf), 5, "record_id")


# ---------------------------------------------------------------------------
# Requests, resume, backends, repair
# ---------------------------------------------------------------------------
_REQ = (f"SELECT doc_id, kind, text, prompt, 'rewrite' AS stage, "
        f"{S.request_id(chr(39) + 'rewrite' + chr(39), 'kind', 'prompt')} AS request_id "
        f"FROM ({_REWRITE}) r")


def _requests(spark, sf):
    return G.request_table(_rewrite(spark, sf), "rewrite")


@register("request_table", f"SELECT doc_id, kind, request_id FROM ({_REQ}) q", ("problems",))
def q_request_table(spark, sf):
    return _requests(spark, sf).select("doc_id", "kind", "request_id")


_TURN_REQ = (f"SELECT record_id, problem AS prompt, "
             f"{S.request_id(chr(39) + 'answer' + chr(39), chr(39) + 'chat' + chr(39), 'problem')}"
             f" AS request_id FROM (SELECT record_id, problem FROM records UNION ALL "
             f"SELECT record_id, input FROM requests_open) u")


def _turn_requests(spark, sf):
    r = V.records(spark, sf).select("record_id", F.col("problem").alias("prompt"),
                                    F.col("answer"))
    o = V.requests_open(spark, sf).select("record_id", F.col("input").alias("prompt"),
                                          F.col("output").alias("answer"))
    return G.request_table(r.unionByName(o).withColumn("kind", F.lit("chat")), "answer")


@register("pending_requests", f"""
SELECT q.record_id, q.request_id FROM ({_TURN_REQ}) q
WHERE NOT EXISTS (SELECT 1 FROM ({_TURN_REQ}) d JOIN records r ON d.record_id = r.record_id
                  WHERE d.request_id = q.request_id)""", ("records", "requests_open"))
def q_pending_requests(spark, sf):
    req = _turn_requests(spark, sf)
    answered = req.where(F.col("answer") != "").select(
        "request_id", F.col("answer").alias("response"), F.lit("ok").alias("status"))
    return G.pending_requests(req, answered).select("record_id", "request_id")


@register("generate_responses", f"""
SELECT DISTINCT request_id, {S.rules_response('stage', 'kind', 'text')} AS response,
       'ok' AS status, 1 AS attempt FROM ({_REQ}) q""", ("problems",))
def q_generate_responses(spark, sf):
    return G.generate_responses(_requests(spark, sf)).select(
        "request_id", "response", "status", "attempt")


def flaky_backend(prompt: str) -> str:
    """Stand-in client for failure capture: deterministic blocks, quota errors
    and crashes by the first hex digit of the prompt's md5; otherwise echoes
    the prompt length."""
    import hashlib
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()[0]
    if h == "0":
        raise G.Blocked("prompt_feedback: block_reason=SAFETY")
    if h == "1":
        raise G.QuotaExceeded("429 quota exceeded")
    if h == "2":
        raise RuntimeError("500 internal error")
    return f"answer of {len(prompt)} characters"


@register("generation_status", f"""
SELECT request_id,
       CASE WHEN h NOT IN ('0', '1', '2')
            THEN 'answer of ' || CAST(length(prompt) AS VARCHAR) || ' characters' END AS response,
       CASE h WHEN '0' THEN 'blocked' WHEN '1' THEN 'quota' WHEN '2' THEN 'error' ELSE 'ok' END
         AS status,
       CASE h WHEN '1' THEN 2 ELSE 1 END AS attempt,
       CASE h WHEN '0' THEN 'prompt_feedback: block_reason=SAFETY'
              WHEN '1' THEN '429 quota exceeded'
              WHEN '2' THEN 'RuntimeError: 500 internal error' END AS error
FROM (SELECT DISTINCT request_id, prompt, substr(md5(prompt), 1, 1) AS h FROM ({_REQ}) q) x""",
          ("problems",))
def q_generation_status(spark, sf):
    return G.generate_responses(_requests(spark, sf), backend=flaky_backend, retry_wait=0.0)


_OLD_RESP = """
SELECT record_id, answer AS response, 1 AS attempt FROM records
UNION ALL SELECT record_id, output, 1 FROM requests_open"""


def _old_responses(spark, sf):
    r = V.records(spark, sf).select("record_id", F.col("answer").alias("response"))
    o = V.requests_open(spark, sf).select("record_id", F.col("output").alias("response"))
    return r.unionByName(o).select(
        F.col("record_id").cast("string").alias("request_id"), "response",
        F.lit("ok").alias("status"), F.lit(1).alias("attempt"),
        F.lit(None).cast("string").alias("error"))


@register("repair_empty", f"""
SELECT CAST(record_id AS VARCHAR) AS request_id,
       CASE WHEN response = '' THEN {S.rule_questions("'ambiguous'", 'prompt')} ELSE response END
       AS response,
       CASE WHEN response = '' THEN 2 ELSE 1 END AS attempt
FROM ({_OLD_RESP}) o JOIN (SELECT record_id, problem AS prompt FROM records UNION ALL
                           SELECT record_id, input FROM requests_open) p USING (record_id)""",
          ("records", "requests_open"))
def q_repair_empty(spark, sf):
    r = V.records(spark, sf).select("record_id", F.col("problem").alias("text"))
    o = V.requests_open(spark, sf).select("record_id", F.col("input").alias("text"))
    req = r.unionByName(o).select(
        F.col("record_id").cast("string").alias("request_id"), "text",
        F.lit("question").alias("stage"), F.lit("ambiguous").alias("kind"),
        F.col("text").alias("prompt"))
    out = G.repair_empty(_old_responses(spark, sf), req)
    return out.select("request_id", "response", "attempt")


@register("latest_attempt", """
SELECT CAST(record_id AS VARCHAR) AS request_id,
       CASE WHEN conv_id_even THEN answer ELSE '' END AS response,
       CASE WHEN conv_id_even THEN 2 ELSE 1 END AS attempt
FROM (SELECT record_id, answer, (record_id // 4294967296) % 2 = 0 AS conv_id_even FROM records) r""",
          ("records",))
def q_latest_attempt(spark, sf):
    r = V.records(spark, sf)
    first = r.select(F.col("record_id").cast("string").alias("request_id"),
                     F.lit("").alias("response"), F.lit(1).alias("attempt"))
    second = (r.where((F.shiftright("record_id", 32) % 2) == 0)
              .select(F.col("record_id").cast("string").alias("request_id"),
                      F.col("answer").alias("response"), F.lit(2).alias("attempt")))
    return G.latest_attempt(first.unionByName(second))


# ---------------------------------------------------------------------------
# Class split, plans, sampling, shuffles, splits
# ---------------------------------------------------------------------------
from tunedata.operators import sampling as R  # noqa: E402
from tunedata.operators import preference as D  # noqa: E402

_FLAG = "coalesce(type IS NOT DISTINCT FROM 'Original', false)"


@register("class_split", f"SELECT record_id, type, {_FLAG} AS is_original FROM records",
          ("records",))
def q_class_split(spark, sf):
    return R.class_split(V.records(spark, sf)).select("record_id", "type", "is_original")


@register("filter_original", "SELECT * FROM records WHERE type = 'Original'", ("records",))
def q_filter_original(spark, sf):
    return R.filter_original(V.records(spark, sf))


def plan_sql(table: str, ratio, pick: str = "least") -> str:
    f0, f1 = ratio[0] / 100, ratio[1] / 100
    return f"""
SELECT n_original, n_other, total,
       CAST(floor({f0!r}::DOUBLE * total) AS BIGINT) AS original_target,
       CAST(floor({f1!r}::DOUBLE * total) AS BIGINT) AS other_target
FROM (SELECT *, CAST(floor({pick}(n_original / {f0!r}::DOUBLE, n_other / {f1!r}::DOUBLE))
                     AS BIGINT) AS total
      FROM (SELECT count(*) FILTER (WHERE is_original) AS n_original,
                   count(*) FILTER (WHERE NOT is_original) AS n_other FROM {table}) c) t"""


_CLASSED_F = f"(SELECT doc_id, type, {_FLAG} AS is_original FROM classed)"


@register("sample_plan", plan_sql(_CLASSED_F, (40, 60)), ("classed",))
def q_sample_plan(spark, sf):
    return R.sample_plan(R.class_split(V.classed(spark, sf)), (40, 60))


@register("downsample", f"""
SELECT record_id, rank FROM (SELECT record_id, {S.hash_rank(7, 'record_id')} AS rank
                             FROM records) r WHERE rank <= 100""", ("records",))
def q_downsample(spark, sf):
    return R.downsample(V.records(spark, sf), 100, "record_id", seed=7).select(
        "record_id", "rank")


def draws_sql(seed, n: str) -> str:
    return (f"1 + CAST(('0x' || substr({S.seeded(seed, 'i')}, 1, 12)) AS BIGINT) % {n}")


@register("oversample", f"""
WITH cls AS (SELECT doc_id FROM classed WHERE type = 'Incomplete'),
r AS (SELECT doc_id, {S.hash_rank(3, 'doc_id')} AS rk FROM cls),
d AS (SELECT i + 1 AS sample_id, {draws_sql(3, '(SELECT count(*) FROM cls)')} AS rk
      FROM range(1000) t(i))
SELECT d.sample_id, r.doc_id FROM d JOIN r ON d.rk = r.rk""", ("classed",))
def q_oversample(spark, sf):
    cls = V.classed(spark, sf).where(F.col("type") == "Incomplete")
    return R.oversample(cls, 1000, "doc_id", seed=3).select("sample_id", "doc_id")


def balance_sql(table: str, key: str, ratio, seed, mode: str) -> str:
    """SQL twin of ``sampling.balance`` over ``table(key, ..., is_original)``."""
    pick = "greatest" if mode == "oversample" else "least"
    return f"""
WITH f AS (SELECT * FROM {table}),
p AS ({plan_sql('f', ratio, pick)}),
r AS (SELECT *, {S.hash_rank(seed, key, 'is_original')} AS rk FROM f),
cnt AS (SELECT is_original, count(*) AS n FROM f GROUP BY is_original),
tg AS (SELECT true AS is_original, original_target AS target FROM p
       UNION ALL SELECT false, other_target FROM p),
cls AS (SELECT tg.is_original, tg.target, cnt.n FROM tg JOIN cnt ON tg.is_original = cnt.is_original),
down AS (SELECT r.* EXCLUDE (rk), r.rk AS sample_id FROM r JOIN cls ON r.is_original = cls.is_original
         WHERE (cls.target <= cls.n OR {'false' if mode == 'oversample' else 'true'})
           AND r.rk <= cls.target),
dr AS (SELECT is_original, n, unnest(range(target)) AS i FROM cls WHERE target > n
       AND {'true' if mode == 'oversample' else 'false'}),
draws AS (SELECT is_original, i + 1 AS sample_id, {draws_sql(seed, 'n')} AS rk FROM dr),
up AS (SELECT r.* EXCLUDE (rk), d.sample_id FROM draws d
       JOIN r ON r.is_original = d.is_original AND r.rk = d.rk),
c AS (SELECT * FROM down UNION ALL SELECT * FROM up),
k AS (SELECT *, concat_ws(':', CAST(CAST(is_original AS INTEGER) AS VARCHAR),
                          CAST({key} AS VARCHAR), CAST(sample_id AS VARCHAR)) AS skey FROM c)
SELECT * EXCLUDE (skey), {S.hash_rank(seed, 'skey')} AS position FROM k"""


@register("balance_downsample", f"""
SELECT doc_id, type, is_original, sample_id, position
FROM ({balance_sql(_CLASSED_F, 'doc_id', (40, 60), 11, 'downsample')}) b""", ("classed",))
def q_balance_downsample(spark, sf):
    b = R.balance(V.classed(spark, sf), "doc_id", (40, 60), "downsample", seed=11)
    return b.select("doc_id", "type", "is_original", "sample_id", "position")


@register("balance_oversample", f"""
SELECT doc_id, type, is_original, sample_id, position
FROM ({balance_sql(_CLASSED_F, 'doc_id', (40, 60), 11, 'oversample')}) b""", ("classed",))
def q_balance_oversample(spark, sf):
    b = R.balance(V.classed(spark, sf), "doc_id", (40, 60), "oversample", seed=11)
    return b.select("doc_id", "type", "is_original", "sample_id", "position")


@register("balance_summary", f"""
SELECT CASE WHEN is_original THEN 'Original' ELSE 'other' END AS class,
       count(*) AS selected, CAST(sum(count(*)) OVER () AS BIGINT) AS combined
FROM ({balance_sql(_CLASSED_F, 'doc_id', (40, 60), 11, 'downsample')}) b
GROUP BY is_original""", ("classed",))
def q_balance_summary(spark, sf):
    b = R.balance(V.classed(spark, sf), "doc_id", (40, 60), "downsample", seed=11)
    return R.balance_summary(b)


@register("shuffle_positions", f"SELECT record_id, {S.hash_rank(42, 'record_id')} AS position "
          "FROM records", ("records",))
def q_shuffle_positions(spark, sf):
    return R.shuffle_positions(V.records(spark, sf), "record_id", 42).select(
        "record_id", "position")


_SPLIT = f"""
SELECT record_id, CASE WHEN {S.hash_rank(42, 'record_id')} <= ceil(0.2::DOUBLE * count(*) OVER ())
       THEN 'validation' ELSE 'train' END AS split FROM records"""


@register("train_val_split", _SPLIT, ("records",))
def q_train_val_split(spark, sf):
    return R.train_val_split(V.records(spark, sf), "record_id").select("record_id", "split")


@register("split_sizes", f"SELECT split, count(*) AS n FROM ({_SPLIT}) s GROUP BY split",
          ("records",))
def q_split_sizes(spark, sf):
    return R.split_sizes(R.train_val_split(V.records(spark, sf), "record_id"))


# ---------------------------------------------------------------------------
# Preference data
# ---------------------------------------------------------------------------
_PREF_PROMPT = (f"{S.lit(T.PREFERENCE_PROMPT_PREFIX)} || problem || "
                f"{S.lit(T.PREFERENCE_PROMPT_SUFFIX)}")


@register("preference_pairs", f"""
SELECT record_id, type, {_PREF_PROMPT} AS prompt, answer AS chosen,
       CASE WHEN coalesce(resp, '') = '' THEN {S.lit(D.EMPTY_REJECTED)} ELSE resp END AS rejected
FROM (SELECT *, {S.rules_response("'reject'", 'kind', 'answer')} AS resp
      FROM (SELECT *, CASE WHEN {_FLAG} THEN 'original' ELSE 'other' END AS kind
            FROM records WHERE problem IS NOT NULL AND answer IS NOT NULL) c) x""", ("records",))
def q_preference_pairs(spark, sf):
    return D.preference_pairs(V.records(spark, sf))


def cross_sql(table: str, key: str, seed) -> str:
    return f"""
WITH c AS (SELECT *, {_FLAG} AS is_original FROM {table}
           WHERE problem IS NOT NULL AND answer IS NOT NULL),
r AS (SELECT *, {S.hash_rank(seed, key, 'is_original')} AS rk FROM c),
n AS (SELECT count(*) FILTER (WHERE is_original) AS n_o,
             count(*) FILTER (WHERE NOT is_original) AS n_x FROM c),
ch AS (SELECT r.*, NOT is_original AS opp,
              (rk - 1) % (CASE WHEN is_original THEN n_x ELSE n_o END) + 1 AS prk
       FROM r, n WHERE (CASE WHEN is_original THEN n_x ELSE n_o END) > 0)
SELECT ch.{key}, ch.type, {S.lit(T.PREFERENCE_PROMPT_PREFIX)} || ch.problem ||
       {S.lit(T.PREFERENCE_PROMPT_SUFFIX)} AS prompt, ch.answer AS chosen,
       p.answer AS rejected, p.{key} AS rejected_id
FROM ch JOIN r p ON p.is_original = ch.opp AND p.rk = ch.prk"""


@register("cross_class_rejected", cross_sql("records", "record_id", 5), ("records",))
def q_cross_class_rejected(spark, sf):
    return D.cross_class_rejected(V.records(spark, sf), seed=5)


# ---------------------------------------------------------------------------
# Vocabulary, encoding, labels, batches
# ---------------------------------------------------------------------------
_VOCAB = f"""
SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) + 3 AS INTEGER) AS id, count
FROM (SELECT token, count(*) AS count
      FROM (SELECT unnest({S.toks('problem')}) AS token FROM records
            UNION ALL SELECT unnest({S.toks('answer')}) FROM records) t
      GROUP BY token) c"""


def _vocab(spark, sf):
    r = V.records(spark, sf)
    corpus = r.select(F.concat(TK.tokenize("problem"), TK.tokenize("answer")).alias("tokens"))
    return TK.build_vocab(corpus, "tokens")


@register("build_vocab", _VOCAB, ("records",))
def q_build_vocab(spark, sf):
    return _vocab(spark, sf)


def encode_sql(text_expr: str, limit: int, toks_expr: str | None = None,
               extra: str = "") -> str:
    """CTE chain -> enc(record_id, ids) over records, vocabulary ``vocab``;
    ``t`` holds the (truncated) tokens and any ``extra`` columns."""
    toks = toks_expr or S.toks(text_expr)
    return f"""
vocab AS ({_VOCAB}),
t AS (SELECT record_id, ({toks})[1:{limit}] AS toks{extra} FROM records),
u AS (SELECT record_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t),
j AS (SELECT u.record_id, u.pos, coalesce(v.id, 1) AS id FROM u LEFT JOIN vocab v
      ON u.token = v.token),
enc AS (SELECT t.record_id, CAST(coalesce(g.ids, []) AS INTEGER[]) AS ids FROM t LEFT JOIN
        (SELECT record_id, list(id ORDER BY pos) AS ids FROM j GROUP BY record_id) g
        ON t.record_id = g.record_id)"""


def _encoded(spark, sf, text_col, limit):
    r = V.records(spark, sf).select("record_id", text_col.alias("_text"))
    return TK.encode(r, TK.tokenize("_text"), _vocab(spark, sf), "record_id", limit)


@register("encode", f"WITH {encode_sql('problem || answer', 512)} "
          "SELECT record_id, ids AS input_ids FROM enc", ("records",))
def q_encode(spark, sf):
    return _encoded(spark, sf, P.concat_v1(), 512)


_CAUSAL = ("SELECT record_id, ids AS input_ids, ids AS labels, "
           "list_transform(ids, lambda x: 1) AS attention_mask FROM enc")


@register("encode_eos", f"WITH {encode_sql('problem || answer', 511)} "
          f"SELECT record_id, list_append(ids, {T.EOS_ID}) AS input_ids FROM enc", ("records",))
def q_encode_eos(spark, sf):
    r = V.records(spark, sf).select("record_id", P.concat_v1().alias("_text"))
    return TK.encode(r, TK.tokenize("_text"), _vocab(spark, sf), "record_id", 512, add_eos=True)


@register("labels_v1", f"WITH {encode_sql('problem || answer', 512)} {_CAUSAL}", ("records",))
def q_labels_v1(spark, sf):
    return TK.causal_labels(_encoded(spark, sf, P.concat_v1(), 512))


@register("labels_v3", f"WITH {encode_sql('problem || answer || type', 512)} {_CAUSAL}",
          ("records",))
def q_labels_v3(spark, sf):
    return TK.causal_labels(_encoded(spark, sf, P.concat_v3(), 512))


@register("labels_v4", f"WITH {encode_sql(V4_SQL, 2048)} {_CAUSAL}", ("records",))
def q_labels_v4(spark, sf):
    return TK.causal_labels(_encoded(spark, sf, P.concat_v4(), 2048))


_V2_TOKS = f"list_concat({S.toks('problem')}, {S.toks('answer')})"
_V2_SA = (f", least(len({S.toks('problem')}), 512) AS s, "
          f"least(len({S.toks('answer')}), 512) AS a")


@register("labels_v2", f"""
WITH {encode_sql('', 2048, _V2_TOKS, _V2_SA)}
SELECT enc.record_id, ids AS input_ids,
       list_transform(ids, lambda x, i: CASE WHEN i - 1 >= s AND i - 1 < s + a THEN x
                                             ELSE -100 END) AS labels,
       list_transform(ids, lambda x: 1) AS attention_mask
FROM enc JOIN t ON enc.record_id = t.record_id""", ("records",))
def q_labels_v2(spark, sf):
    return TK.labels_v2(V.records(spark, sf), _vocab(spark, sf))


# --- T1-T5 with the subwords of a public vocabulary ---------------------------
def subword_sql(table: str, key: str, text: str, limit: int | None = None) -> str:
    """CTE chain -> sub(key, ids, ends): ids of the subwords in order and the
    bytes of the text up to the end of each. ``ends`` compare to the bytes
    before a border as code points do. The engine's patterns cannot look
    ahead: the last white space before other text is marked first."""
    path = SW.RANKS_PATH.removeprefix("file://")
    mark = "chr(57344)"
    pattern = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SW.SPACE}\p{{L}}\p{{N}}\x{{e000}}]+"
               rf"|[{SW.SPACE}]+")
    return f"""
sub_rank AS (SELECT hex(from_base64(piece)) AS piece, id
             FROM read_csv('{path}', columns = {{'piece': 'VARCHAR', 'id': 'INTEGER'}},
                           delim = ' ', header = false, quote = '', escape = '')),
sub_text AS (SELECT {key} AS k, regexp_extract_all(
                 regexp_replace({text}, {S.lit(f'([{SW.SPACE}])([^{SW.SPACE}])')},
                                {mark} || '\\1\\2', 'g'), {S.lit(pattern)}, 0) AS ps FROM {table}),
sub_piece AS (SELECT k, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM sub_text),
sub_word AS (SELECT p, hex(encode(p)) AS h FROM (SELECT DISTINCT p FROM sub_piece) d),
sub_merge(p, parts, step) AS (
    SELECT p, list_transform(range(0, len(h) // 2), lambda i: h[2 * i + 1:2 * i + 2]), 0 FROM sub_word
    UNION ALL
    SELECT p, list_concat(parts[1:i - 1], [parts[i] || parts[i + 1]], parts[i + 2:]), step + 1
    FROM (SELECT p, parts, step, arg_min(i, id * 10000000000 + i) AS i
          FROM (SELECT p, parts, step, unnest(range(1, len(parts))) AS i FROM sub_merge) c
          JOIN sub_rank ON piece = parts[i] || parts[i + 1]
          GROUP BY p, parts, step) b),
sub_done AS (SELECT p, arg_max(parts, step) AS parts FROM sub_merge GROUP BY p),
sub_token AS (SELECT k, pos, unnest(parts) AS h, generate_subscripts(parts, 1) AS j
              FROM sub_piece JOIN sub_done USING (p)),
sub_end AS (SELECT k, pos, j, id, CAST(sum(len(h) // 2) OVER (PARTITION BY k ORDER BY pos, j) AS BIGINT) AS e,
                   row_number() OVER (PARTITION BY k ORDER BY pos, j) AS n
            FROM sub_token JOIN sub_rank ON piece = h),
sub AS (SELECT t.k, coalesce(ids, []) AS ids, coalesce(ends, []) AS ends
        FROM sub_text t LEFT JOIN (SELECT k, list(id ORDER BY n) AS ids, list(e ORDER BY n) AS ends
                                   FROM sub_end {f'WHERE n <= {limit}' if limit else ''} GROUP BY k) g
        ON t.k IS NOT DISTINCT FROM g.k)"""


def _ranks(spark):
    return SW.load_ranks(SW.read_ranks(spark))


def _subwords(spark, sf):
    return SW.encode(V.problems(spark, sf), F.col("text"), _ranks(spark), ["doc_id"])


@register("subword_encode", f"WITH RECURSIVE {subword_sql('problems', 'doc_id', 'text')} "
          "SELECT k AS doc_id, ids AS input_ids FROM sub", ("problems",))
def q_subword_encode(spark, sf):
    return _subwords(spark, sf).select("doc_id", "input_ids")


@register("subword_uses", f"""
WITH RECURSIVE {subword_sql('problems', 'doc_id', 'text')},
use AS (SELECT id, CAST(sum(n) AS BIGINT) AS uses, count(*) AS rows_with
        FROM (SELECT k, id, count(*) AS n FROM sub_end GROUP BY k, id) x GROUP BY id)
SELECT r.id, r.piece, coalesce(uses, 0) AS uses, coalesce(rows_with, 0) AS rows_with
FROM sub_rank r LEFT JOIN use ON r.id = use.id""", ("problems",))
def q_subword_uses(spark, sf):
    return SW.token_uses(_subwords(spark, sf), SW.read_ranks(spark), "doc_id")


@register("subword_roundtrip", f"""
WITH RECURSIVE {subword_sql('problems', 'doc_id', 'text')}
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, md5(text) AS text_md5
FROM problems JOIN sub ON doc_id = k""", ("problems",))
def q_subword_roundtrip(spark, sf):
    back = SW.decode(_subwords(spark, sf).select("doc_id", "input_ids"), _ranks(spark))
    return back.select("doc_id", F.size("input_ids").alias("n_tokens"), F.md5("text").alias("text_md5"))


@register("labels_v2_offsets", f"""
WITH RECURSIVE {subword_sql('records', 'record_id', 'problem || answer', 2048)}
SELECT record_id, ids AS input_ids,
       list_transform(ids, lambda x, i: CASE WHEN ends[i] > strlen(problem) THEN x ELSE -100 END) AS labels,
       list_transform(ids, lambda x: 1) AS attention_mask,
       CAST(len(list_filter(range(1, len(ids) + 1), lambda i:
            ends[i] > strlen(problem) AND i > 1 AND ends[i - 1] < strlen(problem))) AS INTEGER) AS straddles
FROM records JOIN sub ON record_id = k""", ("records",))
def q_labels_v2_offsets(spark, sf):
    return SW.answer_labels(V.records(spark, sf), _ranks(spark))


def length_batch_sql(table: str, key: str, length: str, seed=42, bs=4, mega=50) -> str:
    return f"""
SELECT * EXCLUDE (rk, mega, j), mega * {mega} + (j - 1) // {bs} AS batch_id
FROM (SELECT *, row_number() OVER (PARTITION BY mega ORDER BY {length} DESC, rk) AS j
      FROM (SELECT *, (rk - 1) // {mega * bs} AS mega
            FROM (SELECT *, {S.hash_rank(seed, key)} AS rk FROM {table}) a) b) c"""


@register("length_batches", f"""
SELECT record_id, length, batch_id FROM ({length_batch_sql(
    '(SELECT record_id, length(problem || answer) AS length FROM records)',
    'record_id', 'length')}) x""", ("records",))
def q_length_batches(spark, sf):
    r = V.records(spark, sf).select("record_id",
                                    F.length(P.concat_v1()).cast("long").alias("length"))
    return TK.length_batches(r, "length", "record_id").select("record_id", "length", "batch_id")


_PAD = f"""
WITH {encode_sql('problem || answer', 512)},
b AS ({length_batch_sql('(SELECT record_id, ids, len(ids) AS n FROM enc)', 'record_id', 'n')}),
w AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch_id) / 8.0::DOUBLE) * 8 AS INTEGER)
              AS width FROM b)
SELECT record_id, batch_id, width,
       list_concat(list_transform(range(width - n), lambda x: 0), ids) AS input_ids,
       list_concat(list_transform(range(width - n), lambda x: 0),
                   list_transform(ids, lambda x: 1)) AS attention_mask,
       list_concat(list_transform(range(width - n), lambda x: -100), ids) AS labels
FROM w"""


@register("pad_batches", _PAD, ("records",))
def q_pad_batches(spark, sf):
    enc = TK.causal_labels(_encoded(spark, sf, P.concat_v1(), 512))
    # seeded order from the keys alone, joined to rows already partitioned by key
    order = R.hash_rank(V.records(spark, sf).select("record_id"), 42, "record_id", name="_rk")
    b = TK.length_batches(enc.join(order, "record_id").withColumn("_n", F.size("input_ids")),
                          "_n", "record_id", keep_mega=True, rank="_rk")
    return TK.pad_batches(b.drop("_n"), within=("mega_id",)).select(
        "record_id", "batch_id", "width", "input_ids", "attention_mask", "labels")


def _waste_sql(batches: str, name: str) -> str:
    return f"""(SELECT round((sum(cells) - sum(used)) / sum(cells), 6) AS {name},
        count(*) AS {name}_batches
    FROM (SELECT batch_id, CAST(ceil(max(length) / 8.0::DOUBLE) * 8 AS BIGINT) * count(*) AS cells,
                 sum(length) AS used FROM ({batches}) q GROUP BY batch_id) g)"""


_WASTE_BASE = (f"(SELECT record_id, CAST(least(len({S.toks('problem || answer')}), 512) "
               "AS BIGINT) AS length FROM records)")


@register("padding_waste", f"""
SELECT * FROM {_waste_sql(length_batch_sql(_WASTE_BASE, 'record_id', 'length'), 'grouped_waste')} a,
{_waste_sql(f"SELECT *, ({S.hash_rank(42, 'record_id')} - 1) // 4 AS batch_id FROM {_WASTE_BASE} z",
            'ungrouped_waste')} b""", ("records",))
def q_padding_waste(spark, sf):
    r = V.records(spark, sf).select(
        "record_id", F.least(F.size(TK.tokenize(P.concat_v1())), F.lit(512)).cast("long")
        .alias("length"))
    return TK.padding_waste(r, "length", "record_id")


@register("step_budget", f"""
SELECT count(*) AS rows, CAST(8000 AS BIGINT) AS rows_seen,
       round(8000.0::DOUBLE / count(*), 6) AS epochs,
       CAST(greatest(count(*) - 8000, 0) AS BIGINT) AS rows_unseen
FROM ({_SPLIT}) s WHERE split = 'train'""", ("records",))
def q_step_budget(spark, sf):
    tr = R.train_val_split(V.records(spark, sf), "record_id").where(F.col("split") == "train")
    return TK.step_budget(tr)


# ---------------------------------------------------------------------------
# M5-M6: per-record metrics and dataset averages
# ---------------------------------------------------------------------------
def entropy_sql(table: str, key: str, text: str, out: str) -> str:
    return f"""
{out}_t AS (SELECT {key} AS k, unnest({S.toks(f'lower({text})')}) AS tok FROM {table}),
{out}_c AS (SELECT k, count(*) AS n FROM {out}_t GROUP BY k, tok),
{out}_s AS (SELECT k, n, sum(n) OVER (PARTITION BY k) AS tot FROM {out}_c),
{out}_res AS (SELECT k, -sum(n / tot * ln(n / tot + 1e-10)) AS {out} FROM {out}_s GROUP BY k)"""


_METRICS = f"""
WITH {entropy_sql('records', 'record_id', 'problem', 'problem_entropy')},
{entropy_sql('records', 'record_id', 'answer', 'answer_entropy')},
{perplexity_sql('records', 'record_id', 'problem', 'problem_perplexity')},
{perplexity_sql('records', 'record_id', 'answer', 'answer_perplexity')},
m AS (
SELECT r.record_id, r.problem, r.answer,
       round(coalesce(pe.problem_entropy, 0.0), 4) AS problem_entropy,
       round(coalesce(ae.answer_entropy, 0.0), 4) AS answer_entropy,
       round(pp.problem_perplexity, 4) AS problem_perplexity,
       round(ap.answer_perplexity, 4) AS answer_perplexity
FROM records r
LEFT JOIN problem_entropy_res pe ON pe.k = r.record_id
LEFT JOIN answer_entropy_res ae ON ae.k = r.record_id
LEFT JOIN problem_perplexity_res pp ON pp.k = r.record_id
LEFT JOIN answer_perplexity_res ap ON ap.k = r.record_id)"""


@register("record_metrics", _METRICS + "\nSELECT * FROM m", ("records",))
def q_record_metrics(spark, sf):
    return M.record_metrics(V.records(spark, sf))


@register("quality_summary", _METRICS + """
SELECT round(avg(problem_perplexity), 4) AS avg_problem_perplexity,
       round(avg(answer_perplexity), 4) AS avg_answer_perplexity,
       round(avg(problem_entropy), 4) AS avg_problem_entropy,
       round(avg(answer_entropy), 4) AS avg_answer_entropy FROM m""", ("records",))
def q_quality_summary(spark, sf):
    return M.quality_summary(M.record_metrics(V.records(spark, sf)))


# ---------------------------------------------------------------------------
# Sources and sinks (round trips through the shared folder)
# ---------------------------------------------------------------------------
from pyspark.sql import types as ST  # noqa: E402

from tunedata.session import scratch_path  # noqa: E402
from tunedata.sources import io as IO  # noqa: E402

RECORD_SCHEMA = ST.StructType([
    ST.StructField("record_id", ST.LongType()),
    ST.StructField("problem", ST.StringType()),
    ST.StructField("answer", ST.StringType()),
    ST.StructField("type", ST.StringType()),
])


@register("read_problem_dirs", f"""
SELECT doc_id AS problem_id,
       {S.strip("regexp_replace(text, '" + chr(92) + "r" + chr(92) + "n?', chr(10), 'g')")} AS text
FROM problems""", ("problems",))
def q_read_problem_dirs(spark, sf):
    root = scratch_path(spark, "problem-dirs")
    IO.write_problem_dirs(V.problems(spark, sf).withColumnRenamed("doc_id", "problem_id"), root)
    got = IO.read_problem_dirs(spark, root, "*.txt", partitioned=True)
    return got.select(F.col("problem_id").cast("long").alias("problem_id"), "text")


@register("jsonl_roundtrip", "SELECT record_id, problem, answer, type FROM records", ("records",))
def q_jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "jsonl")
    IO.write_jsonl(V.records(spark, sf), path)
    return IO.valid_rows(IO.read_jsonl(spark, path, RECORD_SCHEMA))


# nine forms of a line, as files that grew over time hold them
_DRIFTED = {
    0: ("ok", "problem", "string", "answer", "string", "type", "string"),
    1: ("ok", "problem", "string", "answer", "string", "'Incomplete'", "missing"),
    2: ("ok", "problem", "string", "answer", "string", "NULL", "null"),
    3: ("ok", "problem", "string", "NULL", "null", "type", "string"),
    4: ("ok", "problem", "string", "answer", "string", "type", "string"),
    5: ("corrupt", "NULL", None, "NULL", None, "NULL", None),
    6: ("not_object", "NULL", None, "NULL", None, "NULL", None),
    7: ("ok", "'12'", "other", "'true'", "other", "NULL", "null"),
    8: ("ok", "problem", "string", "NULL", "missing", "type", "string"),
}


def _drifted_lines(spark, sf):
    r = V.records(spark, sf)
    m, lit = F.col("record_id") % len(_DRIFTED), F.lit
    p, a, t = F.col("problem"), F.col("answer"), F.col("type")
    none = lit(None).cast("string")

    def line(**fields):
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    forms = [line(problem=p, answer=a, type=t), line(input=p, output=a), line(problem=p, answer=a, type=none),
             line(input=p, output=none, type=t),
             line(problem=p, answer=a, type=t, extra=F.struct(F.col("record_id").alias("id"))),
             F.concat(lit('{"problem": "'), F.col("record_id")), F.concat(lit("["), F.col("record_id"), lit("]")),
             line(problem=lit(12), answer=lit(True), type=none), line(input=lit("x"), problem=p, type=t)]
    value = F.when(m == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        value = value.when(m == i, f)
    path = scratch_path(spark, "drifted-lines")
    r.select(value.alias("value")).write.text(path)
    return VA.variant_lines(spark, path)


def _by_form(values, quote=True) -> str:
    arms = [f"WHEN {i} THEN {('NULL' if v is None else S.lit(v)) if quote else v}" for i, v in values.items()]
    return f"CASE record_id % {len(_DRIFTED)} " + " ".join(arms) + " END"


@register("variant_ingest", f"""
SELECT {_by_form({i: f[0] for i, f in _DRIFTED.items()})} AS status,
       CASE record_id % {len(_DRIFTED)} WHEN 5 THEN '{{"problem": "' || record_id WHEN 6 THEN '[' || record_id || ']' END AS value,
       {_by_form({i: f[1] for i, f in _DRIFTED.items()}, False)} AS problem,
       {_by_form({i: f[2] for i, f in _DRIFTED.items()})} AS problem_state,
       {_by_form({i: f[3] for i, f in _DRIFTED.items()}, False)} AS answer,
       {_by_form({i: f[4] for i, f in _DRIFTED.items()})} AS answer_state,
       {_by_form({i: f[5] for i, f in _DRIFTED.items()}, False)} AS type,
       {_by_form({i: f[6] for i, f in _DRIFTED.items()})} AS type_state
FROM records""", ("records",))
def q_variant_ingest(spark, sf):
    return VA.ingest(_drifted_lines(spark, sf), defaults={"type": "Incomplete"})


@register("variant_complete", f"""
SELECT {_by_form({i: f[1] for i, f in _DRIFTED.items()}, False)} AS problem,
       {_by_form({i: f[3] for i, f in _DRIFTED.items()}, False)} AS answer
FROM records WHERE record_id % {len(_DRIFTED)} NOT IN (5, 6, 8)""", ("records",))
def q_variant_complete(spark, sf):
    return VA.complete(VA.ingest(_drifted_lines(spark, sf))).select("problem", "answer")


_KEYS = {0: "problem STRING, answer STRING, type STRING", 1: "input STRING, output STRING",
         2: "problem STRING, answer STRING, type NULL", 3: "input STRING, output NULL, type STRING",
         4: "problem STRING, answer STRING, type STRING, extra OBJECT",
         7: "problem BIGINT, answer BOOLEAN, type NULL", 8: "input STRING, problem STRING, type STRING"}


@register("variant_drift", f"""
SELECT split_part(k, ' ', 1) AS key, split_part(k, ' ', 2) AS kind, count(*) AS lines
FROM (SELECT unnest(string_split({_by_form(_KEYS)}, ', ')) AS k FROM records) x GROUP BY ALL""", ("records",))
def q_variant_drift(spark, sf):
    return VA.drift(_drifted_lines(spark, sf))


@register("json_array_scan", "SELECT record_id, problem, answer, type FROM records", ("records",))
def q_json_array_scan(spark, sf):
    path = scratch_path(spark, "json-array")
    IO.write_json_arrays(V.records(spark, sf), path, "record_id", bytes_per_file=64 << 10)
    return IO.read_json_array(spark, f"{path}/*", RECORD_SCHEMA)


@register("append_dataset", "SELECT record_id, problem, answer, type FROM records", ("records",))
def q_append_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    recs = V.records(spark, sf)
    IO.append_dataset(spark, path, R.filter_original(recs), "record_id")
    IO.append_dataset(spark, path, recs, "record_id")
    return IO.append_dataset(spark, path, recs, "record_id")     # rerun adds nothing


_GEN_OUT = """(SELECT record_id, problem AS input, answer AS output FROM records
  UNION ALL SELECT record_id, input, output FROM requests_open)"""


@register("index_nonempty", f"""
SELECT idx, record_id, output FROM (
  SELECT record_id, output, row_number() OVER (ORDER BY record_id) - 1 AS idx FROM {_GEN_OUT} g) x
WHERE output IS NOT NULL AND length(output) > 0""", ("records", "requests_open"))
def q_index_nonempty(spark, sf):
    r = V.records(spark, sf).select("record_id", F.col("problem").alias("input"),
                                    F.col("answer").alias("output"))
    g = r.unionByName(V.requests_open(spark, sf))
    return IO.index_nonempty(g, "record_id").select("idx", "record_id", "output")


# real files of given names, with siblings that are not asked for
@register("named_folders", ORACLE["read_problem_dirs"])
def q_named_folders(spark, sf):
    root = scratch_path(spark, "named-folders")
    p = V.problems(spark, sf)
    FO.write_named(p, root, "doc_id", "text", "question.txt")
    FO.write_named(p.select("doc_id", F.lit("not a question").alias("text")), root, "doc_id", "text", "notes.txt")
    got = IO.read_problem_dirs(spark, root, "question.txt")
    return got.select(F.col("problem_id").cast("long").alias("problem_id"), "text")


@register("export_folders", f"""
SELECT CAST(idx AS VARCHAR) AS id, 'modified_question.txt' AS name, output AS text FROM (
  SELECT record_id, output, row_number() OVER (ORDER BY record_id) - 1 AS idx FROM {_GEN_OUT} g) x
WHERE output IS NOT NULL AND length(output) > 0""", ("records", "requests_open"))
def q_export_folders(spark, sf):
    root = scratch_path(spark, "exported-folders")
    r = V.records(spark, sf).select("record_id", F.col("answer").alias("output"))
    FO.export_nonempty(r.unionByName(V.requests_open(spark, sf).select("record_id", "output")), root, "record_id")
    return FO.read_named(spark, root)


# ---------------------------------------------------------------------------
# Incremental generation (Structured Streaming, availableNow)
# ---------------------------------------------------------------------------
# same answers as the batch job: every request once, whatever the batching
@register("stream_generate", ORACLE["generate_responses"])
def q_stream_generate(spark, sf):
    from tunedata.streaming.generate import stream_generate
    req = _requests(spark, sf).select("request_id", "stage", "kind", "text", "prompt")
    src, sink, ck = (scratch_path(spark, n) for n in ("requests", "responses", "stream-ckpt"))
    half = F.pmod(F.xxhash64("request_id"), F.lit(2))
    req.where(half == 0).write.mode("append").parquet(src)
    stream_generate(spark, src, req.schema, sink, ck)
    req.where(half == 1).write.mode("append").parquet(src)
    stream_generate(spark, src, req.schema, sink, ck)
    stream_generate(spark, src, req.schema, sink, ck)          # nothing new: adds 0 rows
    out = spark.read.parquet(sink)
    return out.select("request_id", "response", "status", "attempt")


# ---------------------------------------------------------------------------
# Whole builds
# ---------------------------------------------------------------------------
from tunedata.plans import builds as W  # noqa: E402

_INITCAP = "upper(substr(kind, 1, 1)) || lower(substr(kind, 2))"
_BUILD = f"""
WITH v AS (SELECT doc_id, kind, {S.rules_response("'rewrite'", 'kind', 'text')} AS variant
           FROM (SELECT doc_id, unnest({S.KINDS}) AS kind, text FROM ({_STRIPPED}) s) e),
g AS (SELECT kind || ':' || CAST(doc_id AS VARCHAR) AS record_id, variant AS problem,
             {S.rules_response("'question'", 'kind', 'variant')} AS answer,
             {_INITCAP} AS type
      FROM v WHERE length(variant) > 0),
o AS (SELECT 'original:' || CAST(record_id AS VARCHAR) AS record_id, problem, answer,
             'Original' AS type FROM records WHERE type = 'Original'),
a AS (SELECT * FROM g UNION ALL SELECT * FROM o)
SELECT *, {S.hash_rank(0, 'record_id')} AS position FROM a"""


def _build_dataset(spark, sf):
    orig = R.filter_original(V.records(spark, sf))
    return W.build_dataset(V.problems(spark, sf), orig, key="doc_id")


@register("build_dataset", _BUILD, ("problems", "records"))
def q_build_dataset(spark, sf):
    return _build_dataset(spark, sf)


_REC_F = f"(SELECT record_id, problem, answer, type, {_FLAG} AS is_original FROM records)"


@register("build_preferences", f"""
WITH bal AS (SELECT record_id, problem, answer, type FROM
             ({balance_sql(_REC_F, 'record_id', (20, 80), 0, 'downsample')}) b)
SELECT * FROM ({cross_sql('bal', 'record_id', 0)}) x""", ("records",))
def q_build_preferences(spark, sf):
    return W.build_preferences(V.records(spark, sf))


_VARIANTS = {
    1: (S.toks("problem || answer"), 512), 2: (_V2_TOKS, 2048),
    3: (S.toks("problem || answer || type"), 512), 4: (S.toks(V4_SQL), 2048),
}


def _batches_sql(variant: int) -> str:
    toks, limit = _VARIANTS[variant]
    vocab = f"""
SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) + 3 AS INTEGER) AS id, count
FROM (SELECT token, count(*) AS count FROM (SELECT unnest({toks}) AS token FROM records) t
      GROUP BY token) c"""
    enc = encode_sql("", limit, toks, _V2_SA if variant == 2 else "").replace(_VOCAB, vocab)
    labels = "ids" if variant != 2 else (
        "list_transform(ids, lambda x, i: CASE WHEN i - 1 >= s AND i - 1 < s + a THEN x "
        "ELSE -100 END)")
    own = ("SELECT record_id, ids, lab, len(ids) AS n FROM sp WHERE split = '{}'")
    halves = " UNION ALL ".join(
        f"SELECT record_id, ids, lab, n, batch_id, '{half}' AS split FROM "
        f"({length_batch_sql('(' + own.format(half) + ')', 'record_id', 'n')}) {half}_b"
        for half in ("train", "validation"))
    return f"""
WITH {enc},
lb AS (SELECT enc.record_id, ids, {labels} AS lab FROM enc JOIN t ON enc.record_id = t.record_id),
sp AS (SELECT *, CASE WHEN {S.hash_rank(42, 'record_id')} <= ceil(0.2::DOUBLE * count(*) OVER ())
              THEN 'validation' ELSE 'train' END AS split FROM lb),
b AS ({halves}),
w AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY split, batch_id) / 8.0::DOUBLE) * 8 AS INTEGER)
              AS width FROM b)
SELECT record_id, split, batch_id, width,
       list_concat(list_transform(range(width - n), lambda x: 0), ids) AS input_ids,
       list_concat(list_transform(range(width - n), lambda x: 0),
                   list_transform(ids, lambda x: 1)) AS attention_mask,
       list_concat(list_transform(range(width - n), lambda x: -100), lab) AS labels
FROM w"""


@register("build_batches", _batches_sql(4), ("records",))
def q_build_batches(spark, sf):
    return W.build_batches(V.records(spark, sf))


def _register_batches(variant: int) -> None:
    @register(f"build_batches_v{variant}", _batches_sql(variant), ("records",))
    def q(spark, sf):
        return W.build_batches(V.records(spark, sf), variant=variant)


for _v in _VARIANTS:
    _register_batches(_v)

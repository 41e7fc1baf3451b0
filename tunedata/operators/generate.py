"""Response generation as a resumable batch job.

The model call itself is a pluggable *backend*. What is built here is the data
work around it: request ids, which requests are still pending, applying the
backend once per distinct request, recording failures as data, repairing
empty answers and keeping the latest attempt.

Backends
* ``"rules"`` (default): deterministic stand-ins for the model, written as
  Catalyst expressions (no Python worker): rewrite -> ``rule_variant``,
  question -> ``rule_questions``, reject -> a worse answer of the opposite
  modality. They reproduce the data flow, not the model's quality.
* any Python callable ``fn(prompt) -> str``: applied with ``mapInPandas`` over
  Arrow batches of distinct requests; a request refused by ``QuotaExceeded`` is
  put off and asked once more ``retry_wait`` seconds after all others, outside
  any task, ``Blocked`` is recorded without retry, any other
  exception is recorded as ``error``. Feedback text never poses as an answer:
  only ``status = 'ok'`` rows carry a response.

Response table: ``(request_id, response, status, attempt, error)``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tunedata.functions import templates as T
from tunedata.functions.text import NUMBER_PATTERN, col_, first_sentence, sentences, strip
from tunedata.session import materialize, table_exists

RESPONSE_SCHEMA = ST.StructType([
    ST.StructField("request_id", ST.StringType()),
    ST.StructField("response", ST.StringType()),
    ST.StructField("status", ST.StringType()),
    ST.StructField("attempt", ST.IntegerType()),
    ST.StructField("error", ST.StringType()),
])

#: Column of ``responses_at`` with ``carry``.
ALONE = "alone"
#: Repeated request ids are marked in so many words of 64 bits, broadcast at any size.
MARK_WORDS = 1 << 20

# FIXED VALUES (stand-in texts of the rules backend; not upstream texts)
NEGATION_LEAD = "It is not the case that: "
QUESTION_FORMS = {
    "ambiguous": ("What exactly is meant by \"", "\"?"),
    "inconsistent": ("Which statement holds, given \"", "\"?"),
    "incomplete": ("What is missing from \"", "\"?"),
}


class QuotaExceeded(Exception):
    """Backend signals a rate/quota limit: wait, then retry once."""


class Blocked(Exception):
    """Backend refused the prompt (safety block): recorded, not retried."""


# --- G1 ----------------------------------------------------------------------
def request_id(stage: Column | str, kind: Column | str, prompt: Column | str,
               params: str = T.GENERATION_PARAMS) -> Column:
    return F.sha2(F.concat_ws("\u0001", col_(stage), col_(kind), F.lit(params),
                              col_(prompt)), 256)


def request_table(df: DataFrame, stage: str, kind: str = "kind", prompt: str = "prompt",
                  params: str = T.GENERATION_PARAMS) -> DataFrame:
    """Add ``stage``, ``params`` and ``request_id`` to rows holding a prompt."""
    return (df.withColumn("stage", F.lit(stage)).withColumn("params", F.lit(params))
            .withColumn("request_id", request_id(F.lit(stage), kind, prompt, params)))


# --- G2 ----------------------------------------------------------------------
def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a successful response (keyed anti-join; reruns are
    idempotent and failures are asked again)."""
    done = responses
    if "status" in responses.columns:
        done = responses.where(F.coalesce(F.col("status"), F.lit("ok")) == "ok")
    return requests.join(done.select("request_id"), "request_id", "left_anti")


# --- G7 / G8 (rules backend) -------------------------------------------------
def rule_variant(kind: Column, text: Column, sents: Column) -> Column:
    """ambiguous: number runs -> 'some'; inconsistent: add the negation of the
    first sentence; incomplete: drop the last ``least(n-1, max(1, n//3))`` of
    n sentences. ``sents`` must be a column holding ``sentences(text)`` (only
    read for 'incomplete')."""
    n = F.size(sents)
    drop = F.least(n - 1, F.greatest(F.lit(1), F.floor(n / F.lit(3)).cast("int")))
    first = strip(first_sentence(text))
    return (F.when(kind == "ambiguous", F.regexp_replace(text, NUMBER_PATTERN, "some"))
            .when(kind == "inconsistent", F.concat(text, F.lit("\n" + NEGATION_LEAD), first))
            .when(kind == "incomplete", F.array_join(F.slice(sents, 1, n - drop), "")))


def rule_questions(kind: Column, sents_col: str) -> Column:
    """Numbered clarifying questions, one per non-blank sentence:
    ``1. ...\\n2. ...``. ``sents_col`` is a column of stripped, non-blank
    sentences without trailing periods (see ``question_sentences``)."""
    def one(s, i):
        arms = None
        for k, (pre, post) in QUESTION_FORMS.items():
            v = F.concat((i + 1).cast("string"), F.lit(". " + pre), s, F.lit(post))
            arms = F.when(kind == k, v) if arms is None else arms.when(kind == k, v)
        return arms
    return F.array_join(F.transform(sents_col, one), "\n")


def question_sentences(sents: Column) -> Column:
    """Stripped sentences without trailing periods, blanks dropped (rtrim of
    '.' on stripped text equals removing a final run of periods)."""
    cleaned = F.transform(sents, lambda s: F.rtrim(strip(s), F.lit(".")))
    return F.filter(cleaned, lambda s: s != "")


def rules_backend(requests: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Catalyst stand-in: response per (stage, kind, text)."""
    stage, kind = F.col("stage"), F.col("kind")
    # full sentence arrays only where an output reads them (an ambiguous
    # rewrite needs none, an inconsistent one only the first sentence)
    need = ((stage == "question") | ((stage == "reject") & (kind == "original"))
            | ((stage == "rewrite") & (kind == "incomplete")))
    staged = requests.withColumn("_sents", F.when(need, sentences(text))).withColumn(
        "_qs", question_sentences(F.col("_sents")))
    t, sents = F.col(text), F.col("_sents")
    reject_kind = F.when(kind == "original", F.lit("ambiguous")).otherwise(F.lit("inconsistent"))
    resp = (F.when(F.col("stage") == "rewrite", strip(rule_variant(kind, t, sents)))
            .when(F.col("stage") == "question", rule_questions(kind, "_qs"))
            .when(F.col("stage") == "reject",
                  F.when(kind == "original", rule_questions(reject_kind, "_qs"))
                  .otherwise(strip(rule_variant(reject_kind, t, sents)))))
    return staged.select(
        "request_id", resp.alias("response"),
        F.when(resp.isNull(), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.lit(1).alias("attempt"),
        F.when(resp.isNull(), F.lit("unknown stage or kind")).alias("error"), *carry)


# --- G3 / G4 -----------------------------------------------------------------
def _python_runner(fn: Callable[[str], str], attempt: int, carry: Sequence[str] = ()):
    import pandas as pd

    def call(prompt: str):
        try:
            return fn(prompt), "ok", None
        except QuotaExceeded as e:
            return None, "quota", str(e) or "quota exceeded"
        except Blocked as e:
            return None, "blocked", str(e) or "blocked"
        except Exception as e:  # noqa: BLE001 - recorded per row
            return None, "error", f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            rows = [call(p) for p in pdf["prompt"]]
            yield pd.DataFrame({
                "request_id": pdf["request_id"],
                "response": [r[0] for r in rows],
                "status": [r[1] for r in rows],
                "attempt": attempt,
                "error": [r[2] for r in rows],
                **{c: pdf[c] for c in carry},
            })
    return run


def generate_responses(requests: DataFrame, backend="rules", text: str = "text",
                       retry_wait: float = 60.0, attempt_base: int = 1,
                       parallelism: int | None = None, unique: bool = False,
                       carry: Sequence[str] = ()) -> DataFrame:
    """One response row per distinct ``request_id``. Only the columns the
    backend reads are shuffled by the de-duplication, which ``unique`` leaves
    out: no two requests share an id. ``parallelism``: number
    of tasks that call a client (calls are slow and their bytes few, so the
    partition count by size would be too small). ``carry``: columns of the
    requests (strings or truth values) that stay beside the answers.

    A client's answers are written as they come, so it is called once for each
    attempt, however often the result is read. Requests that it refuses for
    their quota are put off: no task waits for them. Once all others are
    answered, and ``retry_wait`` seconds later, they are asked again together,
    spread over all tasks."""
    if backend == "rules":
        distinct = requests.select(*dict.fromkeys(["request_id", "stage", "kind", text, *carry]))
        distinct = distinct if unique else distinct.dropDuplicates(["request_id"])
        out = rules_backend(distinct, text, carry)
        return out if attempt_base == 1 else out.withColumn("attempt", F.lit(attempt_base))
    if not callable(backend):
        raise ValueError("backend must be 'rules' or a callable prompt -> text")
    from tunedata.session import ship_package
    ship_package(requests.sparkSession)
    distinct = requests.select(*dict.fromkeys(["request_id", "prompt", *carry]))
    distinct = distinct if unique else distinct.dropDuplicates(["request_id"])
    schema = _with_carried(distinct.schema, carry)

    def ask(some: DataFrame, attempt: int, name: str) -> DataFrame:
        if parallelism:
            some = some.repartition(parallelism, "request_id")
        return materialize(some.mapInPandas(_python_runner(backend, attempt, carry), schema), name)

    first = ask(distinct, attempt_base, "responses-first")
    refused = first.where("status = 'quota'").select("request_id")
    if not refused.limit(1).count():
        return first
    time.sleep(retry_wait)                          # of the driver: no executor is held
    again = ask(distinct.join(refused, "request_id", "left_semi"), attempt_base + 1, "responses-again")
    return first.where("status <> 'quota'").unionByName(again)


def number_after(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Attempts of ``new`` continue after each request's last attempt in
    ``previous`` (a retried request gets attempt n + 1, n + 2, ...). Only
    failed or empty attempts can precede a retry, so only those are read, and
    written, so that a few of them are joined without a shuffle of ``new``."""
    again = (F.coalesce(F.col("status"), F.lit("ok")) != "ok") | (F.col("response") == "")
    last = materialize(previous.where(again).groupBy("request_id").agg(F.max("attempt").alias("_prev")), "last-attempts")
    return (new.join(last, "request_id", "left")
            .withColumn("attempt", (F.coalesce(F.col("_prev"), F.lit(0))
                                    + F.col("attempt")).cast("int"))
            .drop("_prev").select(*new.columns))


def _with_carried(schema: ST.StructType, carry: Sequence[str]) -> ST.StructType:
    return ST.StructType([*RESPONSE_SCHEMA.fields, *[schema[c] for c in carry]])


def one_of_each(requests: DataFrame, alone: str | None = None) -> DataFrame:
    """One row per ``request_id``, found by the ids alone: a hash of each id that
    occurs again marks a bit, and only rows with a marked bit are shuffled as a
    whole and told apart by their ids. ``requests`` is read three times.
    ``alone``: a column to add, true for rows that were surely the only one of
    their id (few of the others are as well)."""
    own = requests.columns
    hashed = requests.withColumn("_hash", F.xxhash64("request_id"))
    word, bit = F.pmod("_hash", F.lit(MARK_WORDS)), F.pmod(F.shiftright("_hash", 40), F.lit(64)).cast("int")
    marks = materialize(
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")),
        "repeated-requests")
    marked = (word == F.col("_word")) & (F.bit_get("_bits", bit) == 1)
    once = hashed.join(F.broadcast(marks), marked, "left_anti")
    again = hashed.join(F.broadcast(marks), marked, "left_semi").dropDuplicates(["request_id"])
    flag = [] if alone is None else [alone]
    return once.select(*own, *[F.lit(True).alias(c) for c in flag]).unionByName(
        again.select(*own, *[F.lit(False).alias(c) for c in flag]))


def responses_at(requests: DataFrame, path: str, backend="rules", text: str = "text",
                 retry_wait: float = 60.0, carry: Sequence[str] | None = None) -> DataFrame:
    """The persisted response table for ``requests`` at ``path`` (shared
    storage): answer only the pending requests, append, read back.

    Persisting is what makes a stage resumable and what guarantees the
    backend is called once per request: every later consumer (joins back,
    ranks, several passes) reads the table instead of re-running the model.

    With ``carry`` the result holds the answers to ``requests`` alone, with these
    columns of theirs (strings or truth values) and ``ALONE``: whether the row
    is surely the only request of its id. Otherwise they are those of one of the
    requests that share it. The first run writes them beside the answers, in the
    order of the requests, so that no later step joins texts to find them."""
    spark = requests.sparkSession
    if not table_exists(spark, path):
        columns = ["request_id", "stage", "kind", text] if backend == "rules" else ["request_id", "prompt"]
        asked = requests.select(*dict.fromkeys([*columns, *(carry or [])]))
        beside = [] if carry is None else [*carry, ALONE]
        asked = one_of_each(asked, ALONE if carry is not None else None)
        schema = _with_carried(asked.schema, beside)
        (generate_responses(asked, backend, text, retry_wait, unique=True, carry=beside)
         .write.mode("append").option("compression", "zstd").parquet(path))
        return spark.read.schema(schema).parquet(path)       # one row a request
    done = spark.read.schema(RESPONSE_SCHEMA).parquet(path)
    todo = pending_requests(requests, done)
    new = number_after(generate_responses(todo, backend, text, retry_wait), done)
    new.write.mode("append").option("compression", "zstd").parquet(path)
    latest = latest_attempt(spark.read.schema(RESPONSE_SCHEMA).parquet(path))
    if carry is None:
        return latest
    return latest.join(one_of_each(requests.select("request_id", *carry), ALONE), "request_id")


def repaired_at(requests: DataFrame, path: str, backend="rules", repairs: int = 1,
                text: str = "text", retry_wait: float = 60.0, carry: Sequence[str] | None = None) -> DataFrame:
    """``responses_at``, then up to ``repairs`` rounds in which requests whose
    latest response is '' are asked again; every attempt is appended to the
    table at ``path``."""
    spark = requests.sparkSession
    current = responses_at(requests, path, backend, text, retry_wait, carry)
    for _ in range(repairs):
        # written, so that a few of them are joined without a shuffle of the texts
        empty = materialize(current.where(F.col("response") == "").select("request_id"), "empty-answers")
        if not empty.take(1):
            break
        todo = materialize(requests.join(empty, "request_id", "left_semi"), "repairs")
        done = spark.read.schema(RESPONSE_SCHEMA).parquet(path)
        again = materialize(number_after(generate_responses(todo, backend, text, retry_wait), done), "repaired")
        again.write.mode("append").parquet(path)
        # the new attempts are the latest ones; all other rows stay
        new = again.select("request_id", *[F.col(c).alias(f"_new_{c}") for c in again.columns if c != "request_id"])
        asked = F.col("_new_attempt").isNotNull()
        current = current.join(new, "request_id", "left").select(*[
            F.when(asked, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in new.columns else c
            for c in current.columns])
    return current


# --- G5 / G6 -----------------------------------------------------------------
def latest_attempt(responses: DataFrame) -> DataFrame:
    """One row per request: the highest attempt.

    An aggregate, not a window: ``max_by`` is combined map-side, so a request
    with very many attempts is never one task. Ties on the attempt (a replayed
    append) are broken by response, then status, so recomputation after a
    lost executor keeps the same row."""
    cols = responses.columns
    order = [c for c in ("attempt", "response", "status") if c in cols]
    best = (responses.groupBy("request_id")
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_best")))
    return best.select(*[F.col("_best")[c].alias(c) for c in cols])


def repair_empty(responses: DataFrame, requests: DataFrame, backend="rules",
                 text: str = "text", retry_wait: float = 60.0) -> DataFrame:
    """Ask again the requests whose latest response is exactly '' and merge:
    the new attempt (previous attempt + 1) replaces the old one; every other
    row is kept as it is."""
    current = latest_attempt(responses)
    empty = current.where(F.col("response") == "").select("request_id")
    todo = requests.join(empty, "request_id", "left_semi")
    again = number_after(generate_responses(todo, backend, text, retry_wait), current)
    return latest_attempt(current.unionByName(again.select(*current.columns)))

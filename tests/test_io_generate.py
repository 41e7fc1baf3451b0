"""File round trips, corrupt lines, resume, repair, streaming."""
import os

import pytest
from pyspark.sql import functions as F

from tunedata.operators import generate as G
from tunedata.sources import io as IO
from tunedata.streaming.generate import stream_generate

SCHEMA = "input STRING, output STRING, type STRING"


def test_jsonl_corrupt_line_kept_then_excluded(spark, tmp_shared):
    path = tmp_shared("jsonl")
    spark.createDataFrame([('{"input":"a","output":""}',), ("not json",),
                           ('{"input":"b","output":"x","type":null}',)], "value STRING") \
        .write.text(path)
    from pyspark.sql.types import StructType
    df = IO.read_jsonl(spark, path, StructType.fromDDL(SCHEMA))
    bad = df.where(F.col("_corrupt_record").isNotNull()).select("input", "_corrupt_record")
    assert [r._corrupt_record for r in bad.collect()] == ["not json"]
    assert IO.valid_rows(df).count() == 2


def test_write_jsonl_keeps_nulls(spark, tmp_shared):
    path = tmp_shared("jsonl-nulls")
    IO.write_jsonl(spark.createDataFrame([("a", None)], "input STRING, type STRING"), path)
    line = spark.read.text(path).first()[0]
    assert '"type":null' in line


def test_problem_dirs_skip_missing_and_strip(spark, tmp_shared):
    root = tmp_shared("dirs")
    IO.write_problem_dirs(spark.createDataFrame(
        [("1", " \t q \r\n"), ("2", "a\r\n\r\nb")], "problem_id STRING, text STRING"), root)
    os.makedirs(os.path.join(root, "problem_id=3"))            # folder without a file
    got = {r.problem_id: r.text for r in IO.read_problem_dirs(spark, root, "*.txt", partitioned=True).collect()}
    assert got == {"1": "q", "2": "a\n\nb"}


def test_index_nonempty_keeps_gaps(spark):
    df = spark.createDataFrame([(10, "x"), (20, ""), (30, None), (40, "y")],
                               "k LONG, output STRING")
    got = [(r.idx, r.k) for r in IO.index_nonempty(df, "k").orderBy("k").collect()]
    assert got == [(0, 10), (3, 40)]


def test_append_is_idempotent(spark, tmp_shared):
    path = tmp_shared("append")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "record_id LONG, v STRING")
    IO.append_dataset(spark, path, rows.where("record_id = 1"), "record_id")
    IO.append_dataset(spark, path, rows, "record_id")
    assert IO.append_dataset(spark, path, rows, "record_id").count() == 2


def _requests(spark, n=20):
    df = spark.range(n).select(F.col("id").alias("pid"),
                               F.concat(F.lit("Problem "), F.col("id").cast("string"),
                                        F.lit(". It has 2 parts.")).alias("text"))
    df = df.withColumn("kind", F.lit("ambiguous")).withColumn("prompt", F.col("text"))
    return G.request_table(df, "rewrite")


def test_resume_answers_each_request_once(spark):
    req = _requests(spark)
    first = G.generate_responses(req.where("pid < 10"))
    todo = G.pending_requests(req, first)
    assert todo.count() == 10
    second = G.generate_responses(todo)
    allr = first.unionByName(second)
    assert allr.count() == 20 == allr.select("request_id").distinct().count()
    assert G.pending_requests(req, allr).count() == 0


def test_failure_capture_statuses(spark):
    calls = {}

    def backend(p):
        if p.startswith("Q"):
            raise G.QuotaExceeded("slow down")
        if p.startswith("B"):
            raise G.Blocked("SAFETY")
        if p.startswith("E"):
            raise RuntimeError("boom")
        return p.upper()

    df = spark.createDataFrame([(p, p, "ambiguous") for p in ["Q1", "B1", "E1", "ok1", "ok2"]],
                               "prompt STRING, text STRING, kind STRING")
    req = G.request_table(df, "rewrite")
    out = {r.request_id: r for r in G.generate_responses(req, backend,
                                                         retry_wait=0).collect()}
    st = sorted((r.status, r.attempt) for r in out.values())
    assert st == [("blocked", 1), ("error", 1), ("ok", 1), ("ok", 1), ("quota", 2)]
    assert all(r.response is None for r in out.values() if r.status != "ok")
    assert not calls


def test_repair_and_latest_attempt(spark):
    req = _requests(spark, 4)
    resp = G.generate_responses(req).withColumn(
        "response", F.when(F.col("request_id") == req.first().request_id, F.lit(""))
        .otherwise(F.col("response")))
    fixed = G.repair_empty(resp, req)
    rows = fixed.collect()
    assert len(rows) == 4 and all(r.response for r in rows)
    assert sorted(r.attempt for r in rows) == [1, 1, 1, 2]
    two = spark.createDataFrame([("r", "old", 1), ("r", "new", 2)],
                                "request_id STRING, response STRING, attempt INT")
    assert [r.response for r in G.latest_attempt(two).collect()] == ["new"]


def test_rule_variants(spark):
    df = spark.createDataFrame([("A has 12 items. B has 3.\nC ends",)], "text STRING")
    df = df.withColumn("_s", G.sentences("text"))
    r = df.select(*[G.rule_variant(F.lit(k), F.col("text"), F.col("_s")).alias(k)
                    for k in ("ambiguous", "inconsistent", "incomplete")]).first()
    assert r.ambiguous == "A has some items. B has some.\nC ends"
    assert r.inconsistent.endswith("\nIt is not the case that: A has 12 items.")
    assert r.incomplete == "A has 12 items. B has 3.\n"


def test_stream_second_run_adds_nothing(spark, tmp_shared):
    req = _requests(spark, 30).select("request_id", "stage", "kind", "text", "prompt")
    src, sink, ck = tmp_shared("req"), tmp_shared("resp"), tmp_shared("ck")
    req.write.parquet(src)
    stream_generate(spark, src, req.schema, sink, ck)
    n1 = spark.read.parquet(sink).count()
    stream_generate(spark, src, req.schema, sink, ck)
    assert n1 == 30 == spark.read.parquet(sink).count()


def test_build_dataset_resume_calls_backend_once(spark, tmp_shared):
    from tunedata.plans.builds import build_dataset
    probs = spark.createDataFrame([(i, f"Task {i} has 3 steps. Do them. Report.") for i in range(6)],
                                  "problem_id LONG, text STRING")
    work = tmp_shared("resume")
    first = build_dataset(probs, workdir=work).collect()
    n1 = {s: spark.read.parquet(f"{work}/responses-{s}").count() for s in ("rewrite", "question")}
    again = build_dataset(probs, workdir=work).collect()
    n2 = {s: spark.read.parquet(f"{work}/responses-{s}").count() for s in ("rewrite", "question")}
    # nothing asked twice; the six ambiguous variants are the same text
    # ("Task some has some steps. ..."), so their question prompt is asked once
    assert n1 == n2 == {"rewrite": 18, "question": 13}
    assert sorted((r.record_id, r.position) for r in first) == \
        sorted((r.record_id, r.position) for r in again)
    assert sorted(r.position for r in first) == list(range(1, 19))


def test_cross_class_with_single_original(spark):
    from tunedata.operators.preference import cross_class_rejected
    rows = [(0, "p0", "code0", "Original")] + [(i, f"p{i}", f"q{i}", "Ambiguous") for i in range(1, 30)]
    df = spark.createDataFrame(rows, "record_id LONG, problem STRING, answer STRING, type STRING")
    out = {r.record_id: r for r in cross_class_rejected(df, seed=3).collect()}
    assert len(out) == 30
    assert all(out[i].rejected == "code0" for i in range(1, 30))   # every other row: the code
    assert out[0].rejected.startswith("q") and out[0].prompt == "Problem: p0\n\nSolution:"


def test_responses_at_retries_failures_with_next_attempt(spark, tmp_shared):
    def down(p):
        raise G.QuotaExceeded("429")

    req = _requests(spark, 3)
    path = tmp_shared("responses")
    first = {r.status for r in G.responses_at(req, path, down, retry_wait=0).collect()}
    assert first == {"quota"}
    again = G.responses_at(req, path, lambda p: "fine", retry_wait=0).collect()
    assert {(r.status, r.attempt, r.response) for r in again} == {("ok", 3, "fine")}
    # nothing pending any more: a third run appends nothing
    G.responses_at(req, path, down, retry_wait=0)
    assert spark.read.parquet(path).count() == 6

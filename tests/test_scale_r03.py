"""What a step shuffles and writes stays small beside the texts it works on."""

import pathlib
import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tunedata.operators import anchors as AN
from tunedata.operators import generate as G
from tunedata.operators import metrics as M
from tunedata.operators import prompts as P
from tunedata.sources import io as IO
from tunedata.streaming import generate as SG


def test_templates_are_learned_without_writing_texts(spark, monkeypatch):
    written = {}

    def recording(df, name, own=AN.materialize):
        written[name] = df.schema
        return own(df, name)

    monkeypatch.setattr(AN, "materialize", recording)
    rng = random.Random(3)
    middle = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(9)) for _ in range(80)]
    head, tail = "What is wrong with the following text, in short? ", " Answer in one sentence."
    long = "x" * 300 + " is what every text of the second template begins with: "     # beyond AN.NEAR
    rows = [head + m + tail for m in middle] + [long + m + "!" + "y" * 280 for m in middle] + [None, ""]
    got = AN.learn_templates(spark.createDataFrame([(r,) for r in rows], "prompt string"))
    assert {tuple(r) for r in got.collect()} == {(head, tail, 80), (long, "!" + "y" * 280, 80)}
    assert not any(f.dataType == ST.StringType() for n, s in written.items() if n != "anchors-templates" for f in s)


def test_problem_folders_start_no_process_for_a_file(spark, tmp_shared):
    """Names and contents are those of Spark's own partitioned text writer,
    which starts processes for each local file (0.02 s); tasks write directly."""
    ids = ["1", "a b", "x=1", "p+q", "50%25", "ü", "q?*", "s/t", "", None, "two", "two"]
    df = spark.createDataFrame([(k, None if k == "x=1" else f"text of {k}\r\n") for k in ids],
                               "problem_id string, text string")
    ours, theirs = tmp_shared("ours"), tmp_shared("theirs")
    for _ in range(2):                                    # the second run replaces the first
        IO.write_problem_dirs(df, ours)
    df.repartition(1).write.partitionBy("problem_id").text(theirs)

    def found(root):
        base = pathlib.Path(root)
        assert (base / "_SUCCESS").exists()
        return {f.parent.name: b"".join(sorted(g.read_bytes() for g in f.parent.glob("*.txt")))
                for f in base.glob("*/*.txt")}
    assert {k: sorted(v) for k, v in found(ours).items()} == {k: sorted(v) for k, v in found(theirs).items()}
    assert not list(pathlib.Path(ours).glob("**/.*.crc"))  # not made by Spark's writer


def _plans(monkeypatch, writer):
    """The plans of all tables that are written."""
    seen = []

    def recording(self, path, *a, own=writer.parquet, **k):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return own(self, path, *a, **k)
    monkeypatch.setattr(writer, "parquet", recording)
    return seen


def _asked(spark, n=400):
    df = spark.range(n).select(F.col("id").alias("problem_id"), F.concat(
        F.lit("Problem "), F.col("id") % 300, F.lit(". It has 2 parts.")).alias("text"), F.lit("ambiguous").alias("kind"))
    return G.request_table(P.rewrite_prompt(df), "rewrite")


def test_requests_are_told_apart_by_their_ids(spark, tmp_shared, monkeypatch):
    req = _asked(spark)
    path = tmp_shared("responses")
    seen = _plans(monkeypatch, DataFrameWriter)
    got = G.repaired_at(req, path)
    assert not any("max_by" in p for p in seen + [got._jdf.queryExecution().executedPlan().toString()])
    assert got.count() == 300 == got.select("request_id").distinct().count()
    # a blank answer is asked again, all others stay
    answer = lambda p: "" if "Problem 7." in p else "fine"
    path = tmp_shared("blank")
    got = {r.request_id: (r.response, r.attempt) for r in G.repaired_at(req, path, answer, repairs=2).collect()}
    assert sorted(got.values()) == [("", 3)] + [("fine", 1)] * 299


def test_a_stream_shuffles_texts_once(spark, tmp_shared, monkeypatch):
    req = _asked(spark).select("request_id", "stage", "kind", "text", "prompt")
    src, sink, ck = (tmp_shared(n) for n in ("src", "sink", "ck"))
    req.write.parquet(src)
    seen = _plans(monkeypatch, DataFrameWriter)
    SG.stream_generate(spark, src, req.schema, sink, ck)
    assert len(seen) == 1 and seen[0].count("Exchange") == 1       # no table of the batch beside the answers
    req.withColumn("request_id", F.concat("request_id", F.lit("x"))).unionByName(req).write.mode("append").parquet(src)
    SG.stream_generate(spark, src, req.schema, sink, ck)
    out = spark.read.parquet(sink)
    assert out.count() == 600 == out.select("request_id").distinct().count()
    assert out.select(F.max("attempt")).first()[0] == 1


def test_perplexity_shuffles_numbers(spark, monkeypatch):
    """Pairs are written, counted and joined as hashes of their words, with the results of a given model of words."""
    written = {}

    def recording(df, name, own=M.materialize):
        written[name] = df.schema
        return own(df, name)

    monkeypatch.setattr(M, "materialize", recording)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefg,.") for _ in range(rng.randrange(9)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    own = {r.k: r.perplexity for r in M.perplexity(df, "k", "t").collect()}
    assert set(written) >= {"bigram-pairs", "bigram-counts", "bigram-losses"}
    assert not any(f.dataType == ST.StringType() for s in written.values() for f in s)
    given = {r.k: r.perplexity for r in M.perplexity(df, "k", "t", model=M.train_bigram(df, "k", "t")).collect()}
    assert set(own) == set(given) == {k for k, _ in rows} and own[60] is None
    assert all((own[k] is None and given[k] is None) or abs(own[k] - given[k]) < 1e-9 for k in own)

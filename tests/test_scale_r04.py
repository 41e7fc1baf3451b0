"""The driver holds no list of files, and texts are neither shuffled nor written more often than a step needs."""

import gzip
import hashlib
import pathlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.functions.text import normalize_newlines, strip
from tunedata.operators import generate as G
from tunedata.operators import prompts as P
from tunedata.plans import builds as W
from tunedata.sources import folders as FO
from tunedata.sources import io as IO


def test_named_files_are_listed_by_tasks(spark, tmp_shared, monkeypatch):
    """Spark's reader kept each file of all folders in the driver's memory."""
    root = tmp_shared("folders")
    df = spark.range(300).select("id", F.concat(F.lit(" question "), "id").alias("text"))
    FO.write_named(df, root)
    FO.write_named(df, root, name="notes.txt")
    (pathlib.Path(root.removeprefix("file:")) / "none").mkdir()
    monkeypatch.setattr(FO, "FOLDERS_PER_TASK", 50)
    monkeypatch.setattr(FO, "NAMES_AT_ONCE", 3)
    monkeypatch.setattr(FO, "BYTES_AT_ONCE", 500)
    got = IO.read_problem_dirs(spark, root, "question.txt")
    assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism + 1     # of names, not of texts
    assert got.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, got.collect())) == sorted((str(i), f"question {i}") for i in range(300))
    both = FO.read_named(spark, root)
    assert len(both.inputFiles()) <= spark.sparkContext.defaultParallelism + 1
    assert both.count() == 600 == both.distinct().count()
    empty = tmp_shared("no-folders")
    pathlib.Path(empty.removeprefix("file:")).mkdir()
    assert IO.read_problem_dirs(spark, empty).collect() == [] == FO.read_named(spark, empty).collect()


def test_partitioned_folders_are_listed_by_tasks(spark, tmp_shared):
    root = tmp_shared("parts")
    IO.write_problem_dirs(spark.range(300).select(F.col("id").alias("problem_id"), F.lit("text").alias("text")), root)
    got = IO.read_problem_dirs(spark, root, "*.txt", partitioned=True)
    assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism + 1
    assert sorted(int(r.problem_id) for r in got.collect()) == list(range(300))


def test_listed_files_are_those_of_sparks_reader(spark, tmp_shared):
    root = pathlib.Path(tmp_shared("odd tree").removeprefix("file:"))
    for folder in ("a b", "x=1", "_y=2", "_hidden", ".hidden", "_metadata", "p+q", "50%25", "ü", "c._COPYING_"):
        (root / folder / "deep").mkdir(parents=True)
        for name in ("a.txt", "b.txt", "b1.txt", "ab.txt", "a,b", "(a).txt", "_a.txt", "_k=a.txt", ".a.txt", "[a].txt", "deep/a.txt"):
            (root / folder / name).write_bytes(f" {folder} {name}\r\n".encode())
        (root / folder / "empty.txt").touch()
        (root / folder / "bytes.txt").write_bytes(b"\xff\xfe\r\x00 z\xc3")
        (root / folder / "packed.txt.gz").write_bytes(gzip.compress(b"packed"))
    (root / "beside.txt").write_text("beside the folders")
    for glob in ("a.txt", "*.txt", "?.txt", "[ab].txt", "[!a].txt", "[^a].txt", "{a,b1}.txt", "a,b", "(a).txt", "\\[a\\].txt", "[a-b][0-9].txt",
                 "*.gz", "bytes*", "empty.txt", "*", "deep/a.txt", "A.txt", "a.tx"):
        raw, folder = IO._spark_problem_dirs(spark, str(root), str(root), glob)
        theirs = raw.select(folder.alias("problem_id"), strip(normalize_newlines("value")).alias("text"))
        ours = IO.read_problem_dirs(spark, str(root), glob)

        def rows(df):
            return sorted((r[0], bytes(r[1])) for r in df.select("problem_id", F.col("text").cast("binary")).collect())
        assert rows(ours) == rows(theirs), glob
    for wrong in ("[a", "{a", "a\\"):
        with pytest.raises(ValueError):
            IO.glob_pattern(wrong)


def _row_by_row(probs):
    """Records of ``build_dataset`` with each row's requests answered on their own."""
    rows = P.rewrite_prompt(P.expand_variants(P.strip_text(probs))).withColumn("id", F.monotonically_increasing_id())
    first = G.rules_backend(G.request_table(rows, "rewrite"), carry=["problem_id", "kind"]).where("length(response) > 0")
    ask = P.question_prompt(first.select("problem_id", "kind", F.col("response").alias("text")))
    return G.rules_backend(G.request_table(ask, "question"), carry=["problem_id", "kind", "text"]).where(
        "length(response) > 0").select(
            F.concat("kind", F.lit(":"), "problem_id"), F.col("text"), "response", F.initcap("kind"))


def _problems(spark):
    rows = [(i, f"Task {i % 40} has {i % 7} steps. Do them. Report {i % 23}.") for i in range(120)]
    rows += [(i, f"Only {i}.") for i in range(200, 210)] * 2 + [(None, "No id. Of 3."), (None, "No id. Of 3."), (7, "Another 7. Text.")]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "..."), (304, "... 5")]
    return spark.createDataFrame(rows, "problem_id LONG, text STRING")


def _checked(got, expected, originals):
    rows = got.collect()
    want = Counter(map(tuple, expected.collect())) + Counter((f"original:{i}", p, a, "Original") for i, p, a in originals)
    assert Counter((r.record_id, r.problem, r.answer, r.type) for r in rows) == want

    def order(k):
        return (k is None, hashlib.md5(f"0:{k}".encode()).hexdigest() if k is not None else "", k or "")
    by_position = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in by_position] == list(range(1, len(rows) + 1))
    keys = [order(r.record_id) for r in by_position]
    assert keys == sorted(keys)


@pytest.mark.parametrize("words", [1 << 20, 1])            # with one word nearly all requests are marked
def test_shared_requests_reach_all_their_rows(spark, tmp_shared, monkeypatch, words):
    """Repeated and null ids, repeated texts, variants that several texts share, blank answers, a rerun with more rows."""
    monkeypatch.setattr(G, "MARK_WORDS", words)
    monkeypatch.setattr(W, "PART_ROWS", 1 << 20 if words > 1 else 8)
    probs = _problems(spark).repartition(5)
    originals = [(1, "p", "a"), (1, "p", "b"), (2, "q", "c")]
    o = spark.createDataFrame(originals, "record_id INT, problem STRING, answer STRING")
    work = tmp_shared("build")
    some = probs.where("problem_id is null or problem_id % 3 = 0")
    _checked(W.build_dataset(some, o, workdir=work), _row_by_row(some), originals)
    first = spark.read.parquet(f"{work}/responses-question").where("attempt = 1")
    assert first.count() == first.select("request_id").distinct().count()
    _checked(W.build_dataset(probs, o, workdir=work), _row_by_row(probs), originals)
    _checked(W.build_dataset(probs, o), _row_by_row(probs), originals)


def test_client_answers_carry_their_rows(spark):
    probs = spark.createDataFrame([(2 ** 53 + 1, "One. Two 2."), (None, "One. Two 2."), (5, "Three."), (None, "Four.")],
                                  "problem_id LONG, text STRING")
    got = W.build_dataset(probs, backend=lambda p: f"answer to {len(p)}").collect()
    assert Counter(r.record_id for r in got) == Counter(
        {f"{k}:{i}": 1 for k in T.KINDS for i in (2 ** 53 + 1, 5)}) + Counter({None: 2 * len(T.KINDS)})


def test_build_moves_no_texts(spark, tmp_path):
    """Answers, records and positions were joined by shuffles of whole texts; each was written as often."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = [(i, ". ".join(" ".join(word() for _ in range(10)) for _ in range(20))) for i in range(300)]
    probs = spark.createDataFrame(rows, "problem_id LONG, text STRING").repartition(4)
    size = sum(len(t) for _, t in rows)
    work = tmp_path / "build"
    got = W.build_dataset(probs, workdir=str(work))
    final = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in final.splitlines() if "FileScan" in x and "answer" in x)
    assert "Bucketed: true" in scan                       # positions come to the texts
    assert got.count() == 900
    written = sum(f.stat().st_size for f in work.rglob("*.parquet"))
    assert written < 5 * size, written / size             # variants, problems, answers: 15 texts of each problem


def test_repeated_requests_are_marked_in_bounded_space(spark, monkeypatch):
    """The ids of repeated requests were joined as a table: where that was not small, all texts were shuffled."""
    monkeypatch.setattr(G, "MARK_WORDS", 64)
    ids = spark.range(30_000).select(F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("request_id"), F.lit("text").alias("text"))
    written = {}

    def recording(df, name, own=G.materialize):
        written[name] = own(df, name)
        return written[name]
    monkeypatch.setattr(G, "materialize", recording)
    got = G.one_of_each(ids, "alone")
    assert written["repeated-requests"].count() <= 64
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.groupBy("request_id").agg(F.count("*").alias("n"), F.max("alone").alias("alone"))
    assert rows.count() == 20_000 and rows.where("n > 1").count() == 0
    repeated = spark.range(10_000).select(F.sha2(F.col("id").cast("string"), 256).alias("request_id"))
    assert rows.where("alone").join(repeated, "request_id").count() == 0
    assert rows.where("alone").count() > 0

"""Named files in folders: round trips, odd names, siblings, tasks run twice."""
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tunedata.sources import folders as FO
from tunedata.sources import io as IO

NAMES = ["1", "a b", "ü😀", "a/b", "..", ".", "", ".hidden", "_meta", "x%2Fy", "%", "k=v", "c:\\d", "+ plus", "\n"]


def local(path):
    return pathlib.Path(path.removeprefix("file:"))


def test_round_trip_of_odd_ids(spark, tmp_shared):
    root = tmp_shared("folders")
    rows = [(n, f"text of {n!r}\r\n with  blanks ") for n in NAMES] + [("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    FO.write_named(df, root, name="question.txt")
    got = {(r.id, r.name, r.text) for r in FO.read_named(spark, root).collect()}
    assert got == {(i, "question.txt", t or "") for i, t in rows}
    folders = [p for p in local(root).iterdir()]
    assert len(folders) == len(rows) and all(p.is_dir() for p in folders)
    assert all([f.name for f in p.iterdir()] == ["question.txt"] for p in folders)


def test_siblings_deeper_folders_and_replacement(spark, tmp_shared):
    root = tmp_shared("folders")
    df = spark.range(2500).select("id", F.concat(F.lit("question "), "id").alias("text"))
    FO.write_named(df, root)
    FO.write_named(df.limit(10), root, name="notes.txt")
    base = local(root)
    (base / "stray.txt").write_text("beside the folders")
    (base / "none").mkdir()
    (base / "7" / "deep").mkdir()
    (base / "7" / "deep" / "question.txt").write_text("too deep")
    (base / "_temporary").mkdir()
    (base / "_temporary" / "question.txt").write_text("hidden")
    read = FO.read_named(spark, root, "question.txt")
    assert read.rdd.getNumPartitions() == 3               # listed in parts of 1,000 folders
    assert {(r.id, r.text) for r in read.collect()} == {(str(i), f"question {i}") for i in range(2500)}
    assert FO.read_named(spark, root).count() == 2510
    assert IO.read_problem_dirs(spark, root).count() == 2500
    FO.write_named(df.where("id < 3").withColumn("text", F.lit("new")), root)
    assert FO.read_named(spark, root, "question.txt").where("text = 'new'").count() == 3
    assert FO.read_named(spark, root).count() == 2510


def test_ids_that_cannot_be_written(spark, tmp_shared):
    root = tmp_shared("folders")
    for rows in ([("a", "1"), ("a", "2")], [(None, "1")]):
        with pytest.raises(ValueError, match="null or names several"):
            FO.write_named(spark.createDataFrame(rows, "id string, text string"), root)
    assert not local(root).exists()


def test_a_task_that_runs_twice_leaves_the_same_files(tmp_path):
    writer = FO._Writer({"path": str(tmp_path)})
    rows = [{"id": str(i % 5), "name": f"{i}.txt", "text": "x" * i} for i in range(20)]
    writer.write(iter(rows[:7]))                          # lost on the way
    writer.write(iter(rows))
    random.Random(1).shuffle(rows)
    writer.write(iter(rows))
    files = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file())
    assert files == sorted(f"{r['id']}/{r['name']}" for r in rows)


def test_export_numbers_before_it_drops(spark, tmp_shared):
    root = tmp_shared("folders")
    df = spark.createDataFrame([(5, "five"), (1, ""), (3, None), (2, "two")], "k int, output string")
    FO.export_nonempty(df, root, "k")
    got = {(r.id, r.name, r.text) for r in FO.read_named(spark, root).collect()}
    assert got == {("1", "modified_question.txt", "two"), ("3", "modified_question.txt", "five")}


def test_small_texts_are_written_by_many_tasks(spark, tmp_shared, monkeypatch):
    """Rows of a few bytes were put into one task that made every folder alone."""
    dealt = []
    real = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, *a: dealt.append(a) or real(df, *a))
    monkeypatch.setattr(FO, "FOLDERS_PER_TASK", 100)
    FO.write_named(spark.range(5000).withColumn("text", F.lit("x")), tmp_shared("folders"))
    assert dealt and isinstance(dealt[-1][0], int) and dealt[-1][0] >= 50

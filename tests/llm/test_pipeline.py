"""Each stage of the pipeline against a brute-force version on its own input."""
import random
from collections import Counter

import pytest
from edge_rows import EXTRA, PASSAGE, SCHEMA, edge_docs, empty_docs
from pyspark.sql import functions as F
from test_native import brute_dedup, brute_poisson
from test_python_ops import brute_classes, edited

import __spark_entry__ as E
import corpus_pipeline as P
from tunedata.llm.decontaminate import normal
from tunedata.session import scratch_path

COMMON = {"en": "the of and to in is that with for on was are".split(),
          "fr": "le la les des et que dans pour une est qui pas".split()}


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(11)
    items = [" ".join(f"{rng.choice('bcdfg')}item{rng.randrange(99999)}" for _ in range(12)) for _ in range(4)]

    def line(lang, n):
        return " ".join(rng.choice(COMMON[lang]) if rng.random() < 0.5 else
                        "".join(rng.choice("aeiourstlmn") for _ in range(rng.randint(3, 9)))
                        for _ in range(n))

    texts = []
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        body = [line(lang, rng.randint(8, 14)) for _ in range(rng.randint(5, 12))]
        if i % 9 == 0:
            body.insert(2, PASSAGE)
        if i % 20 == 3:
            body.insert(1, items[i % 4].upper())
        texts.append((lang, "\n".join(body)))
    for i in range(30):                      # near copies on one long line, exact copies
        lang, text = texts[i * 3]
        words = text.split()
        texts.append((lang, edited(words, rng, 1) if i % 3 else text))
    texts += [(None, "1234 5678 !!"), (None, None), ("en", "")]
    rows = [(i, t, lang, f"s{i % 5}" if i % 2 else "hot", None if t is None else len(t))
            for i, (lang, t) in enumerate(texts)]
    folder = scratch_path(spark, "given")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder, items


def test_stages(spark, given):
    folder, items = given
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            now = {r.doc_id: r for r in got}
            assert len(now) == len(got)
        ids = sorted(before)
        if name == "language_id":
            assert sorted(now) == [i for i in ids if any(c.isalpha() for c in before[i].text or "")]
        elif name == "line_dedup":
            want = brute_dedup([before[i].text for i in ids])
            for j, i in enumerate(ids):
                text, removed = want[j]
                if removed and not text.strip():
                    assert i not in now
                else:
                    assert now[i].text == text and now[i].n_chars == len(text)
            assert len(now) < len(before)
        elif name == "near_dedup":
            classes, links = brute_classes([before[i].text for i in ids])
            want = {min(j for j, c in enumerate(classes) if c == x) for x in set(classes)}
            assert {ids[j] for j in want} == set(now) and len(links) > 5
        elif name == "decontaminate":
            leaks = {i for i in ids if any(normal(x) in normal(before[i].text) for x in items)}
            assert set(now) == set(ids) - leaks and leaks
        else:
            sources = Counter(r.source for r in before.values())
            n = len(before)
            want = Counter()
            for r in before.values():
                want[r.doc_id] = brute_poisson(n / (len(sources) * sources[r.source]), r.doc_id)
            assert Counter(r.doc_id for r in got) == +want
        before = now
    assert sorted(x[0] for x in P.STAGES) == sorted(
        "language_id line_dedup near_dedup decontaminate mix".split())


def test_run_is_the_stages(spark, given):
    folder, _ = given
    out = P.run(spark, folder)
    assert out.columns == [*SCHEMA.fieldNames(), "copy", "mix_key"] and out.count() > 50
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} == {
        k.split("_")[0] for k in E.queries() if k == "pipeline" or k.startswith("op")}


def test_pipeline_edge_rows(spark, given):
    folder, _ = given
    for start in (edge_docs(spark), empty_docs(spark)):
        docs = start
        for name, stage in P.STAGES:
            path = scratch_path(spark, f"edge-{name}")
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
        if start.columns == SCHEMA.fieldNames():
            assert docs.count() == 0
        else:
            # every column is kept, whatever it is called
            assert set(docs.columns) == set(start.columns) and {
                docs.filter(F.col(f"`{c}`") != "clash").count() for c in EXTRA
                if c not in ("copy", "mix_key", "n_lines", "n_removed")} == {0}
            assert docs.filter(F.col("text").isNull()).count() == 0

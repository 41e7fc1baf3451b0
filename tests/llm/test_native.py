"""Line windows, licence digests, mixing and quality rules: edge rows, and the
small cases where the result can be said in advance."""
import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from edge_rows import PASSAGE, SCHEMA, edge_docs, empty_docs, rows
from pyspark.sql import functions as F

from tunedata.llm.licenses import known_texts, license_table, scan_licenses
from tunedata.llm.line_dedup import dedup_lines
from tunedata.llm.mixing import SEED, mix_sources, repetition_rates
from tunedata.llm.quality import quality_rules


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], SCHEMA)


def brute_dedup(texts):
    """{row: (text, removed)} by walking over documents in id order."""
    seen, out = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        full = [(p, x.strip(" \t\n\x0b\x0c\r")) for p, x in enumerate(lines)]
        full = [(p, x) for p, x in full if x]
        gone = set()
        for j in range(len(full) - 2):
            key = tuple(x for _, x in full[j:j + 3])
            if key in seen:
                gone |= set(range(full[j][0], full[j + 2][0] + 1))
            seen.add(key)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def test_lines_like_brute_force(spark):
    texts = [PASSAGE, "a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "p\n\np\np\np\np", PASSAGE + "\n" + PASSAGE,
             "a\n b\nc \n\nd", "", "one", "b\nc"]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs(spark, texts)).collect()}
    assert got == brute_dedup(texts)
    assert got[0] == (PASSAGE, 0) and got[2][0] == "x\ny"


def test_lines_edge_rows(spark):
    df = edge_docs(spark)
    out = dedup_lines(df)
    assert Counter(out.columns)["n_lines"] == 1 and set(df.columns) == set(out.columns)
    got = out.collect()
    assert len(got) == len(rows())
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[(1, None)].text is None and by[(1, None)].n_lines == 0
    assert by[(2, 0)].text == "" and by[(2, 0)].n_lines == 1
    both = [r for r in got if r.doc_id == 6 and r.text.endswith("mine")]
    assert len(both) == 2 and both[0] == both[1]
    other = next(r for r in got if r.doc_id == 7)
    assert other.text == "x" and other.n_removed == 3
    assert sum(PASSAGE in (r.text or "") for r in got if r.doc_id == 6) in (1, 2)
    assert dedup_lines(empty_docs(spark)).count() == 0


def test_hot_window_stays_once(spark):
    df = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"),
                                              F.lit("\n" + PASSAGE)).alias("text"))
    got = dedup_lines(df).filter(F.col("n_removed") > 0)
    assert got.count() == 399 and got.filter("doc_id = 0").count() == 0


def test_licenses(spark):
    mit = next(t for i, t in known_texts() if i == "MIT" and len(t) > 500)
    shouted = "Copyright (c) 2019 A. Person\n\n" + mit.upper().replace("\n", " ")
    texts = [mit, shouted, "intro\nreleased under THE mit licence\nend", mit + " but not quite",
             "Licensed under the Apache Licence, Version 2.0\nReleased under the MIT License.", "", "!!"]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    assert got[0].license_id == "MIT" and got[1].license_id == "MIT"
    assert got[2].license_id is None and got[2].line_licenses == "MIT"
    assert got[3].license_id is None and got[3].line_licenses == ""
    assert got[4].line_licenses == "Apache-2.0,MIT" and got[4].n_license_lines == 2
    assert got[5].text_digest is None and got[6].text_digest is None
    assert got[2].text_digest == hashlib.sha256(b"intro released under the mit license end").hexdigest()


def test_licenses_edge_rows(spark):
    got = scan_licenses(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    assert sum(r.doc_id == 6 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
    assert scan_licenses(empty_docs(spark)).count() == 0
    assert license_table(spark).groupBy("digest").count().filter("count > 1").count() == 0


def brute_poisson(rate, doc_id):
    parts = max(math.ceil(rate / 16), 1)
    n = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{SEED}:{doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = cdf = math.exp(-rate / parts)
        k = 0
        while cdf <= u and k < 200:
            n, k = n + 1, k + 1
            p *= rate / parts / k
            cdf += p
    return n


def test_mix_counts(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(
            F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rates = {r["_mix_key"]: r["rate"] for r in repetition_rates(df).collect()}
    got = mix_sources(df)
    n = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    src = {r.doc_id: r.source for r in df.collect()}
    assert all(n.get(i, 0) == brute_poisson(rates[s], i) for i, s in src.items())
    per = [r["count"] for r in got.groupBy("source").count().collect()]
    assert len(per) == 8 and max(per) < 1.25 * min(per)


def test_mix_large_rate_and_weights(spark):
    df = spark.createDataFrame([(i, "big") for i in range(300)] + [(1000, "tiny"), (1001, None)],
                               "doc_id long, source string")
    weights = spark.createDataFrame([("big", 1.0), ("tiny", 1.0), ("gone", 3.0)],
                                    "source string, weight double")
    rate = {r["_mix_key"]: r["rate"] for r in repetition_rates(df, weights).collect()}
    assert rate["tiny"] == pytest.approx(151) and rate[None] == 0
    got = mix_sources(df, weights).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in got}
    assert None not in got and abs(got["tiny"] - 151) < 60 and abs(got["big"] - 151) < 60
    assert got["tiny"] == brute_poisson(rate["tiny"], 1000)


def test_mix_edge_rows(spark):
    df = edge_docs(spark)
    out = mix_sources(df, budget=40.0)
    assert set(out.columns) == set(df.columns)
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert "clash" not in keys and len(keys) > 100
    assert out.filter("text is null").count() and out.filter("doc_id is null").count()
    twice = out.filter("doc_id = 6 and text like '%mine'").groupBy("copy").count().collect()
    assert twice and all(r["count"] == 2 for r in twice)
    assert mix_sources(empty_docs(spark)).count() == 0


def test_mix_spreads_rows_without_an_id(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"),
                                  F.col("id").cast("string").alias("text"))
    out = mix_sources(df)
    n = out.count()
    assert 0.9 * 4000 < n < 1.1 * 4000
    assert out.select("mix_key").distinct().count() == n
    assert 0.55 * 4000 < out.select("text").distinct().count() < 0.72 * 4000      # 1 - 1/e of them


def test_quality_base_like_brute_force(spark):
    texts = ["the a b " * 20, "One two three. " * 30 + "x|y #tag 50%", "a\nb\na\n\n \na", "w " * 49,
             " ".join(f"u{i}" for i in range(80)), "é\U0001F600 ñ\x0bz", ""]
    got = {r.doc_id: r for r in quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k for j, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_keeps_prose_and_drops_junk(spark):
    base = ("It was the best of the times and the worst of the ages, for we had all in the house "
            "and none of the rain was on the field when a man of the town came to see the sea. ")
    prose = [" ".join(w for j, w in enumerate(base.split() * 6) if (j * 7 + i) % 11) for i in range(30)]
    junk = [" ".join(f"{w}%%%###" for w in prose[0].split()), "Q9 ".join(str(j * j) for j in range(90))]
    got = {r.doc_id: r for r in quality_rules(docs(spark, prose + junk)).collect()}
    fresh = {i: r for i, r in got.items() if not r.base_failed}
    assert all(r.kept for i, r in fresh.items() if i < 30)
    assert not got[30].kept and not got[31].kept
    assert got[30].class_distance > 0.3 and got[0].class_distance < 0.2


def test_quality_edge_rows(spark):
    got = quality_rules(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    none = next(r for r in got if r.doc_id == 1)
    assert none.n_words == 0 and none.base_failed and none.word_distance is None
    assert quality_rules(empty_docs(spark)).count() == 0
    alone = edge_docs(spark, extra=False).withColumn("lang", F.lit(None).cast("string"))
    assert all(r.nearest_lang is None and r.kept == (not r.base_failed)
               for r in quality_rules(alone).collect())


def test_oracles_match(spark):
    from conftest import SF001

    from tunedata.llm.registry import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    assert set(ORACLE) == {"op2_divergence_rules", "op4_line_windows", "op8_license_digests",
                           "op9_poisson_mix", "op11_angular_negatives", "op12_sparse_fim"}
    for key, sql in ORACLE.items():
        df = QUERIES[key](spark, SF001)
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), key
        order = sorted(df.columns)
        want = Counter(rel.project(", ".join(order)).fetchall())
        assert Counter(tuple(r) for r in df.select(*order).collect()) == want, key

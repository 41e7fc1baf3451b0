"""Kneser-Ney trigrams: brute force, sums over every context, held-out value."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tunedata.operators import kneser_ney as KN
from tunedata.operators import lookup
from tunedata.operators import metrics as M
from tunedata.sources import views as V


def sentences(seed, count):
    rng = random.Random(seed)
    words = ["the", "a", "cat", "dog", "saw", "ran", "to", "house", "red", "."]
    return [(i, " ".join(rng.choices(words, range(10, 0, -1), k=rng.randrange(0, 15)))) for i in range(count)]


def plain_model(texts):
    """P(w | u v) from the definition, on Python counters."""
    c3 = Counter()
    for t in texts:
        seq = ["<s>", "<s>"] + (t or "").lower().split()
        c3.update(zip(seq, seq[1:], seq[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def discount(c):
        n = Counter(c.values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] else KN.PLAIN_DISCOUNT
    d1, d2, d3 = discount(c1), discount(c2), discount(c3)
    t3, k3, t2, k2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), n in c3.items():
        t3[u, v] += n
        k3[u, v] += 1
    for (v, _), n in c2.items():
        t2[v] += n
        k2[v] += 1
    total = sum(c1.values())

    def p(u, v, w):
        x = max(c1[w] - d1, 0) / total + d1 * len(c1) / total / (len(c1) + 1)
        if t2[v]:
            x = max(c2[v, w] - d2, 0) / t2[v] + d2 * k2[v] / t2[v] * x
        if t3[u, v]:
            x = max(c3[u, v, w] - d3, 0) / t3[u, v] + d3 * k3[u, v] / t3[u, v] * x
        return x
    return p, sorted(c1), set(t3) | {("new", v) for v in t2} | {("new", "words")}


@pytest.mark.parametrize("share", [2e-5, 2.0])
def test_like_the_definition_and_sums_to_one(spark, monkeypatch, share):
    monkeypatch.setattr(lookup, "HEAD_SHARE", share)             # 2.0: nothing by broadcast
    given = sentences(1, 60) + [(100, None), (101, "")]
    df = spark.createDataFrame(given, "k int, t string")
    model = KN.train(KN.text_trigrams(df, "k", "t"))
    p, words, contexts = plain_model([t for _, t in given])
    asked = [(u, v, w) for u, v in sorted(contexts) for w in [*words, "never"]]
    got = {(r.u, r.v, r.w): r.p for r in KN.probabilities(
        spark.createDataFrame(asked, "u string, v string, w string"), model).collect()}
    for a in asked:
        assert got[a] == pytest.approx(p(*a), rel=1e-9)
    for u, v in contexts:
        assert sum(got[u, v, w] for w in [*words, "never"]) == pytest.approx(1, abs=1e-9)
    score = {r.k: r.perplexity for r in KN.perplexity_kn(df, "k", "t").collect()}
    assert len(score) == len(given)
    for k, t in given:
        seq = ["<s>", "<s>"] + (t or "").lower().split()
        loss = [-math.log(p(*g)) for g in zip(seq, seq[1:], seq[2:])]
        want = math.exp(sum(loss) / len(loss)) if loss else None
        assert score[k] == (pytest.approx(want, rel=1e-9) if want else None)


def test_held_out_below_the_bigram(spark):
    docs = V.problems(spark, SF001)
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    kn = KN.perplexity_kn(held, "doc_id", "text", KN.train(KN.text_trigrams(train, "doc_id", "text", 1024)), 1024)
    two = M.perplexity(held, "doc_id", "text", corpus=train)
    mean = lambda d: d.agg(F.avg(F.ln("perplexity"))).first()[0]
    assert mean(kn) < mean(two)


def test_no_counts_at_all(spark):
    none = spark.createDataFrame([], "k int, t string")
    assert KN.perplexity_kn(none, "k", "t").collect() == []
    blank = spark.createDataFrame([(1, " ")], "k int, t string")
    model = KN.train(KN.text_trigrams(blank, "k", "t"))
    assert [tuple(r) for r in KN.perplexity_kn(blank, "k", "t", model).collect()] == [(1, None)]
    some = spark.createDataFrame([(1, "a b a b")], "k int, t string")
    assert KN.perplexity_kn(some, "k", "t", model).first().perplexity == 1.0


def test_hot_lookup_equals_a_left_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaabcdé"), rng.choice("xy")) for i in range(300)]
    table = [(a, b, n + 1, n / 7) for n, (a, b) in enumerate((a, b) for a in "abcé" for b in "xyz")]
    left = spark.createDataFrame(rows, "i int, a string, b string")
    right = spark.createDataFrame(table, "a string, b string, n long, v double")
    want = {(i, dict(((x, y), v) for x, y, _, v in table).get((a, b))) for i, a, b in rows}
    for share in (2e-5, 0.1, 2.0):
        monkeypatch.setattr(lookup, "HEAD_SHARE", share)
        got = lookup.hot_lookup(left, right, ["a", "b"], "n", ["v"]).collect()
        assert {(r.i, r.v) for r in got} == want and len(got) == 300


def test_trigrams_are_written_as_numbers_once(spark, monkeypatch):
    """No table of the model or the scores holds words, and one holds the trigrams: a few bytes for each."""
    written = {}

    def recording(df, name, own=KN.materialize):
        written[name] = own(df, name)
        return written[name]

    monkeypatch.setattr(KN, "materialize", recording)
    rng = random.Random(4)
    words = [f"word{int(rng.paretovariate(0.9)) % 3000}" for _ in range(60_000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 100:i * 100 + 100])) for i in range(600)], "k int, t string")
    model = KN.train(KN.text_trigrams(df, "k", "t"))
    different = len(set(plain_grams([r.t for r in df.collect()])))
    packed = sum(len(r.grams) for r in model.c3.collect())
    assert packed < 10 * different
    KN.perplexity_kn(df, "k", "t", model).collect()
    types = {name: [d for _, d in table.dtypes] for name, table in written.items()}
    assert not any("string" in d for name in types for d in types[name])


def plain_grams(texts):
    for t in texts:
        seq = ["<s>", "<s>", *(t or "").lower().split()]
        yield from zip(seq, seq[1:], seq[2:])


@pytest.mark.parametrize("bucket,numbers", [(7, 1 << 18), (40, 3), (40, 0)])
def test_many_buckets_spread_words_and_parts(spark, monkeypatch, bucket, numbers):
    monkeypatch.setattr(KN, "BUCKET_GRAMS", bucket)
    monkeypatch.setattr(KN, "CHUNK_GRAMS", 50)
    monkeypatch.setattr(KN, "NUMBERS", numbers)
    given = sentences(2, 80) + [(200, "the the the the the"), (201, None)]
    df = spark.createDataFrame(given, "k int, t string")
    model = KN.train(KN.text_trigrams(df, "k", "t"))
    assert model.numbering.buckets > 10 and (model.numbering.spread > 0) == (numbers > 0)
    assert (model.c2.count() > 0) == (numbers > 0)
    p, words, contexts = plain_model([t for _, t in given])
    asked = [(u, v, w) for u, v in sorted(contexts) for w in [*words, "never"]]
    assert len(asked) > model.numbering.buckets * bucket                 # each bucket is asked by parts
    got = {(r.u, r.v, r.w): r.p for r in KN.probabilities(
        spark.createDataFrame(asked, "u string, v string, w string"), model).collect()}
    assert len(got) == len(asked)
    for a in asked:
        assert got[a] == pytest.approx(p(*a), rel=1e-9)


def test_packing_is_undone():
    rng = np.random.default_rng(6)
    for m in (0, 1, 2, 500):
        g = rng.integers(-3, 4, (4, m)) * rng.choice([1, 2**61], (4, m))
        g, _ = KN._counted(np.vstack([g[:3], np.ones(m, np.int64)]))
        assert (KN._unpacked(KN._packed(g)) == g).all()

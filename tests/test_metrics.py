"""Entropy and perplexity against plain-Python brute force."""
import math
import re
from collections import Counter

import regex

from tunedata.functions.text import TOKEN_PATTERN
from tunedata.operators import metrics as M

TEXTS = ["The cat sat on the mat. The cat!", "a a a b", "", "x", "Zwölf Äpfel, zwölf Birnen."]


def _toks(t):
    return regex.findall(TOKEN_PATTERN, t.lower())


def _entropy(t):
    w = _toks(t)
    if not w:
        return 0.0
    c = Counter(w)
    return -sum((n / len(w)) * math.log(n / len(w) + 1e-10) for n in c.values())


def _ppl(texts):
    seqs = {i: _toks(t)[:1024] for i, t in enumerate(texts)}
    pair = Counter()
    for s in seqs.values():
        for j, w in enumerate(s):
            pair[("<s>" if j == 0 else s[j - 1], w)] += 1
    prev = Counter()
    for (p, _), n in pair.items():
        prev[p] += n
    v = len({w for s in seqs.values() for w in s})
    out = {}
    for i, s in seqs.items():
        if not s:
            out[i] = None
            continue
        nll = [-math.log((pair[("<s>" if j == 0 else s[j - 1], w)] + 1) /
                         (prev["<s>" if j == 0 else s[j - 1]] + v)) for j, w in enumerate(s)]
        out[i] = math.exp(sum(nll) / len(nll))
    return out


def _df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k LONG, text STRING")


def test_entropy_matches_python(spark):
    got = {r.k: r.entropy for r in M.with_entropy(_df(spark), "text").collect()}
    for i, t in enumerate(TEXTS):
        assert abs(got[i] - _entropy(t)) < 1e-12


def test_perplexity_matches_python(spark):
    got = {r.k: r.perplexity for r in M.perplexity(_df(spark), "k", "text").collect()}
    exp = _ppl(TEXTS)
    assert set(got) == set(exp)
    for i, v in exp.items():
        assert (got[i] is None) if v is None else abs(got[i] - v) < 1e-9


def test_token_length_stats_empty_gives_no_row(spark):
    empty = spark.createDataFrame([], "problem STRING, answer STRING")
    assert M.token_length_stats(empty).count() == 0
    one = spark.createDataFrame([("a b", None)], "problem STRING, answer STRING")
    r = M.token_length_stats(one).first()
    assert (r.records, r.max_tokens, r.min_tokens) == (1, 2, 2)


def test_value_counts(spark):
    df = spark.createDataFrame([(sorted(["b", "a", "b", "c", "b"]),), ([],)], "s ARRAY<STRING>")
    got = [[(x.value, x.n) for x in r.vc] for r in M.with_value_counts(df, "s", "vc").collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], []]
    assert re.match(r"^\w", "x")


def test_perplexities_one_pass_matches_separate(spark):
    rows = [(i, t, TEXTS[(i + 2) % len(TEXTS)]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k LONG, a STRING, b STRING")
    both = {r.k: (r.pa, r.pb) for r in M.perplexities(df, "k", {"pa": "a", "pb": "b"}).collect()}
    sa = {r.k: r.perplexity for r in M.perplexity(df, "k", "a").collect()}
    sb = {r.k: r.perplexity for r in M.perplexity(df, "k", "b").collect()}
    assert set(both) == set(sa) == set(sb)
    for k, (x, y) in both.items():
        assert (x is None and sa[k] is None) or abs(x - sa[k]) < 1e-9
        assert (y is None and sb[k] is None) or abs(y - sb[k]) < 1e-9


def test_perplexity_with_separate_corpus(spark):
    corpus = ["the cat sat", "the dog sat down", "a cat"]
    scored = ["the cat ran", "zebra", ""]
    seqs = [_toks(t)[:1024] for t in corpus]
    pair, prev = Counter(), Counter()
    for s in seqs:
        for j, w in enumerate(s):
            pair[("<s>" if j == 0 else s[j - 1], w)] += 1
    for (p, _), n in pair.items():
        prev[p] += n
    v = len({w for s in seqs for w in s})
    exp = {}
    for i, t in enumerate(scored):
        s = _toks(t)
        if not s:
            exp[i] = None
            continue
        nll = [-math.log((pair[("<s>" if j == 0 else s[j - 1], w)] + 1)
                         / (prev["<s>" if j == 0 else s[j - 1]] + v)) for j, w in enumerate(s)]
        exp[i] = math.exp(sum(nll) / len(nll))
    df = spark.createDataFrame(list(enumerate(scored)), "k LONG, text STRING")
    cdf = spark.createDataFrame(list(enumerate(corpus)), "k LONG, text STRING")
    got = {r.k: r.perplexity for r in M.perplexity(df, "k", "text", corpus=cdf).collect()}
    assert set(got) == set(exp)
    for k, e in exp.items():
        assert (got[k] is None) if e is None else abs(got[k] - e) < 1e-9


def test_trained_model_table_scores_like_corpus(spark, tmp_shared):
    corpus = spark.createDataFrame(list(enumerate(["the cat sat", "the dog sat down", "a cat"])),
                                   "k LONG, text STRING")
    df = spark.createDataFrame(list(enumerate(["the cat ran", "zebra", ""])), "k LONG, text STRING")
    model = M.train_bigram(corpus, "k", "text", path=tmp_shared("bigram"))
    a = {r.k: r.perplexity for r in M.perplexity(df, "k", "text", model=model).collect()}
    b = {r.k: r.perplexity for r in M.perplexity(df, "k", "text", corpus=corpus).collect()}
    assert set(a) == set(b) and a[2] is None and b[2] is None
    assert abs(a[0] - b[0]) < 1e-9 and abs(a[1] - 9.0) < 1e-9

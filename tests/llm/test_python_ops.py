"""Language ID, LM scoring, decontamination, near copies, HTML and toxicity:
brute-force versions, held-out accuracy and edge rows."""
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF001, SF01
from edge_rows import LONG, edge_docs, empty_docs, rows
from pyspark.sql import functions as F

from tunedata.llm import near_dup, ngram_bloom, toxicity
from tunedata.llm.arrays import utf8, windows, word_hashes
from tunedata.llm.decontaminate import budget, find_contamination, myers, normal, pieces
from tunedata.llm.html_region import best_region, extract_text, train_region
from tunedata.llm.langid import predict_languages, train_langid
from tunedata.llm.registry import QUERIES
from tunedata.llm.toxicity import isotonic, score_toxicity, train_toxicity


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---- words as arrays ----------------------------------------------------------

def test_word_hashes_equal_words():
    texts = ["a b\ta", "", None, " \n", LONG, "é\x0bé", LONG + " tail", "x" * 3_000_000 + " a"]
    found = word_hashes(utf8(texts))
    names = {}
    for t, h in zip(texts, found):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    assert len(windows(found[0], 5)) == 1 and len(windows(found[1], 5)) == 0
    assert len(windows(found[4], 5)) == len(found[4]) - 4


# ---- language ID ---------------------------------------------------------------

def test_languages_held_out(spark):
    got = QUERIES["op1_subword_langid"](spark, SF01).toPandas()
    docs = spark.read.parquet(f"{SF01}/documents.parquet").toPandas()
    both = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs)
    assert (both.held_out == [crc(i, 5) == 0 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all() and both.rejected.mean() < 0.01


def test_languages_do_not_read_the_label(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = train_langid(docs, F.col("doc_id") % 2 == 0)
    hidden = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    seen = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, model).collect()}
    assert seen == {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(hidden, model).collect()}
    strange = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок"), (2, "12 !?"),
                                     (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in predict_languages(strange, model).collect()}
    assert out[1].rejected and out[2].lang_pred == "und" and out[3].lang_pred == "und"
    assert out[2].score == 0 and out[3].rejected


def test_languages_edge_rows(spark):
    model = train_langid(edge_docs(spark), F.lit(True))
    got = predict_languages(edge_docs(spark), model).collect()
    assert len(got) == len(rows()) and {r.doc_id for r in got} == {r[0] for r in rows()}
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 5)) for r in got)
    nothing = train_langid(empty_docs(spark), F.lit(True))
    assert all(r.lang_pred == "und" for r in predict_languages(edge_docs(spark), nothing).collect())
    assert predict_languages(empty_docs(spark), model).count() == 0


# ---- LM scoring ---------------------------------------------------------------

def brute_base(docs):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    toks = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), b""])
            for i, t in docs]
    count = Counter()
    for i, t in toks:
        if crc("" if i is None else i, 7) != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    return [(i, crc("" if i is None else i, 7) == 2, len(t), sum(count[w] > 0 for w in t), n,
             sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for i, t in toks]


@pytest.mark.parametrize("share", [1e-6, 1e-3])
def test_base_scores(spark, monkeypatch, share):
    """With the larger share most words are rare, so the join has work."""
    monkeypatch.setattr(ngram_bloom, "HELD_SHARE", share)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r.doc_id: r for r in ngram_bloom.lm_scores(
        docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    for i, held, n, known, total, base in brute_base([(r.doc_id, r.text) for r in docs.collect()]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    if share == 1e-6:
        assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def brute_pairs(docs):
    """Scores by exact counts of all words and pairs, none of them cut."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    toks = [(crc("" if i is None else i, 7) == 2, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), b""])
            for i, t in docs]
    word, pair = Counter(), Counter()
    for held, t in toks:
        if not held:
            word.update(t)
            pair.update(zip([b"", *t[:-1]], t))        # a start stands as often as an end
    n, v = sum(word.values()), len(word)
    wins = sum(c for (a, b), c in pair.items() if word[a] > 1 and (c - 1) / (word[a] - 1) > (word[b] - 1) / (n - 1))
    w = min(wins / n, 0.9)

    def p(a, b):
        one = (word[b] + 1) / (n + v + 1)
        return w * pair[a, b] / word[a] + (1 - w) * one if word[a] else one
    return [sum(math.log10(p(a, b)) for a, b in zip([b"", *t[:-1]], t)) for _, t in toks]


def test_rare_words_and_pairs_are_counted(spark, monkeypatch):
    """With this share nothing is held: every word and pair is looked up."""
    monkeypatch.setattr(ngram_bloom, "HELD_SHARE", 1.0)
    monkeypatch.setattr(ngram_bloom, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ngram_bloom, "RANGE_BYTES", 50_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    docs += [(10 ** 6 + i, "") for i in range(3)] + [(7, "two rows of one id"), (None, None), (None, "Zyx zyx")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in ngram_bloom.lm_scores(df, held).collect())
    want = sorted((i is None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1, s)
                  for (i, t), s in zip(docs, brute_pairs(docs), strict=True))
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-3)


def test_bloom_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)
    n = np.exp(rng.uniform(0, 12, len(h)))
    levels = ngram_bloom.level_of(n, 1.0)
    bloom = ngram_bloom.LogBloom(int(levels.sum()))
    bloom.add(h, levels)
    found = bloom.levels(h)
    assert (found >= levels).all() and (found == levels).mean() > 0.995
    assert np.abs(np.log(ngram_bloom.count_of(levels, 1.0) / n)).max() < np.log(2) / 4 + 1e-6
    strange = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)
    assert (bloom.levels(strange) > 0).mean() < 0.005


def test_lm_edge_rows(spark):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = ngram_bloom.lm_scores(edge_docs(spark), held).collect()
    want = brute_base([(r[0], r[1]) for r in rows()])
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                   for r in got], key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert ngram_bloom.lm_scores(empty_docs(spark), held).count() == 0
    untrained = ngram_bloom.lm_scores(edge_docs(spark), F.lit(True)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.score == 0 for r in untrained)


# ---- decontamination -----------------------------------------------------------

def least_edits(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_myers_like_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert myers(p, t, 999) == least_edits(p, t)
    assert "".join(x for _, x in pieces("abcdefghij", 3)) == "abcdefghij"


def test_contamination_like_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
                          for _ in range(rng.randint(6, 30)))) for i in range(12)]
    texts = []
    for k in range(60):
        i, item = items[k % 12]
        body = list(item)
        for _ in range(rng.randint(0, 2 + budget(item))):
            at = rng.randrange(len(body))
            body[at] = rng.choice(["", "x", body[at] + "q"])
        pad = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
        texts.append((k, f"{pad}  {''.join(body).upper() if k % 5 == 0 else ''.join(body)}\n{pad}"))
    bench = spark.createDataFrame([*items, (99, None), (98, "  "), (None, "a b c")],
                                  "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(k, i, d) for k, t in texts for i, item in items
            if (d := least_edits(normal(item), normal(t))) <= budget(normal(item))}
    for block in (4 << 20, 300):       # also with several blocks of items
        got = {(r.doc_id, r.item_id, r.distance)
               for r in find_contamination(docs, bench, block_chars=block).collect()}
        assert got == want
    assert 20 < len(want) < 60 and any(d for _, _, d in want)


def test_contamination_edge_rows(spark):
    bench = spark.createDataFrame([(1, "the second SHARED line and"), (2, "word3 the of and word4")],
                                  "item_id long, text string")
    got = find_contamination(edge_docs(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, 2), (6, 1), (6, 1), (6, 1), (7, 1)]
    assert find_contamination(empty_docs(spark), bench).count() == 0
    assert find_contamination(edge_docs(spark), bench.limit(0)).count() == 0


# ---- near copies -----------------------------------------------------------------

def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(7)
    out = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(base))
        out += [edited(base, rng, rng.randint(0, len(base) // 20)) for _ in range(rng.randint(0, 12))]
    hot = [f"h{rng.randrange(3000)}" for _ in range(200)]
    out += [" ".join(hot)] * 60 + [edited(hot, rng, rng.randint(1, 3)) for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(90)) for _ in range(150)]
    rng.shuffle(out)
    return out


def brute_classes(texts):
    """Connected texts by all pairs that share a shingle, exact document
    frequencies; {row: class} and the similar pairs of different texts."""
    words = [near_dup.windows(h, 5) for h in near_dup._words(texts)]
    frequency = Counter(s for w in words for s in set(w.tolist()))
    top = math.log(len(texts))
    idf = lambda s: 1 + near_dup.IDF_SLOPE * (top - math.log(frequency[s])) / top
    sets = [{s: n * idf(s) for s, n in Counter(w.tolist()).items()} for w in words]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = []
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        low = sum(min(sets[a][x], sets[b][x]) for x in sets[a].keys() & sets[b].keys())
        if low / (sum(sets[a].values()) + sum(sets[b].values()) - low) >= 0.8:
            links.append((a, b))
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(i) for i in range(len(texts))], links


def test_near_copies_like_brute_force(spark, copies):
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    want, links = brute_classes(copies)
    assert len(links) > 500
    lost = [p for p in links if got[p[0]].class_id != got[p[1]].class_id]
    assert len(lost) <= 0.002 * len(links)
    joined = sum(got[i].class_id != want[i] for i in range(len(copies)))
    assert joined <= 0.01 * len(copies)
    assert all(got[i].is_first == (got[i].class_id == i) for i in got)
    kept = near_dup.first_of_each_class(df).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in got.values()})


def test_near_copies_in_a_family(spark):
    # drifted copies, mostly under 0.8 to each other, of which some have a near copy
    rng = random.Random(11)

    def drifted(words, n, tag):
        words = list(words)
        for i in rng.sample(range(57), n):
            words[i * 7 + 3] = f"{tag}x{i}"
        return words

    family = [drifted([f"w{i}" for i in range(400)], 5, f"f{k}") for k in range(150)]
    hidden = [(k, len(family) + i) for i, k in enumerate(range(0, 150, 3))]
    texts = [" ".join(w) for w in family + [drifted(family[k], 6, f"h{k}") for k, _ in hidden]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    want, links = brute_classes(texts)
    assert set(hidden) <= set(links)
    assert [p for p in links if got[p[0]] != got[p[1]]] == []
    # shared slots of the sketch of document frequencies join a few at the limit
    assert len(set(got.values())) >= 0.9 * len(set(want))


def test_draws_follow_similarity():
    rng = np.random.default_rng(3)
    sampler = near_dup.Sampler()
    shares, truth = [], []
    for _ in range(300):
        s = np.unique(rng.integers(0, 2 ** 64, 60, dtype=np.uint64))
        wa, wb = rng.uniform(0.5, 4, len(s)), rng.uniform(0.5, 4, len(s))
        shares.append((sampler.draw(s, wa) == sampler.draw(s, wb)).mean())
        truth.append(near_dup.weighted_jaccard((s, wa), (s, wb)))
    assert abs(np.mean(shares) - np.mean(truth)) < 0.02


def test_near_copies_edge_rows(spark):
    got = near_dup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.class_id for r in by[1] + by[2] + by[3]] == [1, 2, 3]
    assert by[None][0].class_id is None and by[4][0].class_id == 4
    kept = near_dup.first_of_each_class(edge_docs(spark))
    assert set(kept.columns) == set(edge_docs(spark).columns)
    assert kept.filter("text like '%mine'").count() == 1
    assert kept.filter("doc_id in (1, 2, 3) or doc_id is null").count() == 4
    assert near_dup.near_duplicates(empty_docs(spark)).count() == 0


# ---- HTML ------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header class="site-header">Top of site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies here</div>%s<h1>Title &amp; more</h1><p>One  two
 thr<b>ee</b> &lt;4&gt;</p><div class="ad">Buy now buy now</div><p>Five &#233; six<p>Seven
<form><input name=x>Your mail <button>Go</button></form><section id="comments"><p>First! nice text</p></section>
%s<aside>See also</aside><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more\nOne two three <4>\nFive é six\nSeven"


def test_pages(spark):
    marked = [(i, "u", PAGE % ("<article>", "</article>")) for i in range(5)]
    other = [(10, "u", PAGE % ("<div class=post>", "</div>")), (11, None, None), (12, "u", ""),
             (13, "u", "<p>cut off in <b>bold</b> &am"), (14, "u", "no markup at all"),
             (14, "u", "no markup at all"), (None, "u", "<nav>only a menu</nav>"),
             (15, "u", "<p " + "a='b' " * 5000 + "<div" + "<p>x y" * 20_000)]
    df = spark.createDataFrame(marked + other, "page_id long, url string, html string")
    model = train_region(df)
    got = extract_text(df.withColumn("text", F.lit("clash")), model).collect()
    assert len(got) == len(marked) + len(other)
    by = {r.page_id: r for r in got}
    assert by[0].text == TEXT and by[0].n_chars == len(TEXT)
    assert by[10].text == TEXT
    assert by[11].text == "" and by[12].text == "" and by[None].text == "" and by[11].n_chars == 0
    assert by[13].text == "cut off in bold &am" and by[14].text == "no markup at all"
    assert by[15].text.count("x y") == 20_000
    untrained = extract_text(df, train_region(df.filter("page_id > 9"))).collect()
    assert {r.page_id: r for r in untrained}[10].text == TEXT
    assert extract_text(df.limit(0), model).count() == 0


def test_pages_with_names_of_menus(spark):
    marked = [(i, "u", PAGE % ("<article>", "</article>")) for i in range(5)]
    body = "<h1>Title</h1><p>One two three four five six</p>"
    text = "Title\nOne two three four five six"
    wrapped = [f'<body><nav>Menu</nav><div class="{c}"><article>{body}</article></div><footer>us</footer>'
               for c in ("content has-sidebar", "no-sidebar", "page with-comments", "search-layout", "search")]
    parts = [f'<article><{e}>{body}</{e.split()[0]}></article>'
             for e in ('div class="article-header"', 'section class="related-work"',
                       'section id="popular-science"')]
    raw = [f"<article>{x}{body}</article>" for x in ("<svg/>", "<object>", "<noscript>", '<svg a="b" />')]
    cut = [f'<article>{body}<div class="{c}">Read this too</div></article>'
           for c in ("related", "related-posts", "share_buttons", "ad-container", "x cookie-notice")]
    cut += [f"<article>{body}{x}</article>" for x in (
        "<svg><text>a</text></svg>", "<noscript>no</noscript>", '<div class="related"><article>More</article></div>')]
    pages = wrapped + parts + raw + cut
    df = spark.createDataFrame(marked + [(10 + i, "u", p) for i, p in enumerate(pages)],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(df, train_region(df.filter("page_id < 10"))).collect()}
    assert {p: got[10 + i] for i, p in enumerate(pages)} == dict.fromkeys(pages, text)


def test_best_region_like_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        sums = {(a, b): sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        a, b = best_region(np.array(s, float))
        assert sum(s[a:b]) == max([0, *sums.values()])


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op7_best_region"](spark, SF01).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        words = lambda t: re.findall(r"\w+", t)
        import html
        assert words(got[r.page_id]) == words(html.unescape(re.sub(r"<[^>]+>", " ", inner)))


# ---- toxicity ---------------------------------------------------------------------

def test_toxicity_held_out(spark):
    got = QUERIES["op10_boosted_toxicity"](spark, SF01).toPandas()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (got.held_out == [crc(i, 3) == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    held = both[both.held_out]
    assert held[held.predicted == 1].toxic.mean() > 0.9
    assert held[held.toxic == 1].predicted.mean() > 0.6


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(4, 0), (6, 1), (6, 0), (7, 1), (8, 0), (9, None), (None, 1)],
                                   "doc_id long, toxic int")
    model = train_toxicity(edge_docs(spark), labels, F.lit(True))
    assert len(score_toxicity(edge_docs(spark), model).collect()) == len(rows())
    none = train_toxicity(edge_docs(spark), labels.limit(0), F.lit(True))
    assert all(r.score == 0 and r.predicted == 0
               for r in score_toxicity(edge_docs(spark), none).collect())
    assert score_toxicity(empty_docs(spark), model).count() == 0


def test_isotonic_like_definition():
    x, y = isotonic(np.array([1., 2, 3, 4, 5, 5]), np.array([0., 1, 0, 1, 1, 0]))
    assert list(np.interp([1, 2, 3, 4, 5], x, y)) == pytest.approx([0, .5, .5, 2 / 3, 2 / 3])


def test_masked_words():
    lexicon = toxicity.Lexicon({"blarg": 3.0}, {})

    def found(text):
        toxicity._use(lexicon)
        x = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
        return x["masked"] > 0, x["unmasked"]

    for word in ("a$$ a55 idi-ot mor.on mor_on 1diot b@stard sh1t bla-rg b1arg! (a$$) a$$. a55! "
                 "idi-ot, mor.on! bl4rg").split():
        known = word != "b1arg!"
        assert found(f"such {word} here") == (True, float(known)), word
    for text in ("well-known end.", "idiot!", "idiot.", "a shit, b", "see file_name v2 now", "Stop!"):
        assert found(text)[1] == 0, text

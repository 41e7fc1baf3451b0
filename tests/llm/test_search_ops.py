"""Fill-in-middle, hard negatives and the shingle join against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF01
from edge_rows import LONG, edge_docs, empty_docs, rows
from pyspark.sql import functions as F

from tunedata.llm import fim, grouped, hard_negatives as hn, shingle_join as sj

# ---- fill-in-middle -----------------------------------------------------------


def plain_fim(doc_id, text):
    """The contract, word by word, on Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def random_texts(count, seed):
    rng = random.Random(seed)
    letters = "ab é€😀\n<PSM>̈日本"
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for i in range(count)]


def test_index_turns_bytes_and_characters_into_each_other():
    for _, text in random_texts(300, 1):
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fim.ExceptionIndex.of(raw)
        chars = np.arange(len(text) + 1)
        cuts = index.to_bytes(chars)
        assert cuts.tolist() == [len(text[:i].encode()) for i in chars]
        assert index.to_chars(cuts).tolist() == chars.tolist()
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


def test_fim_equals_the_contract_and_round_trips(spark):
    given = [*random_texts(800, 2), *[(i, t) for i, t, *_ in rows()], (-7, "a<P>b"), (3, "€" * 100_001)]
    df = spark.createDataFrame(given, "doc_id long, text string")
    out = fim.fim_transform(df, keep=["doc_id", "text"]).withColumn(
        "back", fim.fim_restore(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    assert got == Counter((i, t, *plain_fim(i, t)) for i, t in given)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fim_edge_rows(spark):
    extra = edge_docs(spark).withColumn("Form", F.lit("clash")).withColumn("draws", F.lit(1))
    out = fim.fim_transform(extra, keep=extra.columns)
    assert out.count() == len(rows())
    assert "Form" not in out.columns and {"draws", "score", "form", "output"} <= set(out.columns)
    assert out.filter("draws = 1 AND score = 'clash'").count() == len(rows())
    assert fim.fim_transform(empty_docs(spark)).collect() == []


def test_fim_pieces_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(random_texts(300, 3), "doc_id long, text string").coalesce(1)
    whole = Counter(map(tuple, fim.fim_transform(df).collect()))
    data = [("x" + t, i) for i, t in random_texts(300, 3)]
    ends = np.cumsum([0] + [len(t.encode()) for t, _ in data])
    raw = np.frombuffer("".join(t for t, _ in data).encode(), np.uint8)
    draws = np.tile(np.arange(4), (len(data), 1)) * 12345
    one = [c.to_pylist() for c in fim._piece(raw, ends, draws, 90, 20)]
    each = [[c.to_pylist()[0] for c in fim._piece(raw[a:b], np.array([0, b - a]), draws[:1], 90, 20)]
            for a, b in zip(ends, ends[1:])]
    assert [list(r) for r in zip(*one)] == each
    assert len(whole) == 300


# ---- hard negatives -----------------------------------------------------------


def plain_negatives(given):
    """(id, label, vector) rows; every score by Python integers."""
    def whole(v):
        return [int(np.floor(256 * float(x))) for x in v]
    ok = [(i, la, tuple(whole(v))) for i, la, v in given
          if i is not None and la is not None and v is not None
          and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a in {r for r in ok if r[0] % 50 == 0}:
        scored = {(-sum(x * y for x, y in zip(a[2], v)), i, la == a[1]) for i, la, v in ok if i != a[0]}
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            window = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            for k, (m, n, _) in enumerate(window):
                out[(a[0], p, k + 1, n, -s, -m)] += 1
    return out


def vectors(count, seed, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dims))
    out = []
    for i in range(count):
        v = base[rng.integers(12)] * rng.uniform(0.1, 3) + rng.normal(size=dims) * rng.choice([0.01, 0.4])
        out.append((i, int(rng.integers(3)), [float(np.float32(x)) for x in v]))
    return out


@pytest.mark.parametrize("tile,block", [(1 << 20, 1024), (97, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, tile, block):
    given = vectors(700, 1)
    given += [(i, 1, given[3][2]) for i in range(1000, 1040)]              # one vector, many ids
    given += [given[5], given[5], given[50], given[50]]                     # repeated rows
    given += [(2000, None, [1.0] * 8), (None, 1, [1.0] * 8), (2001, 1, None), (2002, 2, []),
              (2050, 1, [float("nan")] * 8), (2100, 2, [float("inf")] + [0.0] * 7), (2003, 1, [None, 1.0]),
              (2150, 0, [0.0] * 8), (2200, 1, [3.0]), (-50, 2, [0.5] * 11)]
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    df = spark.createDataFrame(given, "vec_id long, label int, embedding array<float>").repartition(5)
    got = Counter(map(tuple, hn.hard_negatives(df).collect()))
    assert got == plain_negatives(given) and len(got) > 100


def test_bounds_hold_and_the_filter_leaves_pairs_out():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    v = np.floor(256 * (base[rng.integers(6, size=900)] + 0.1 * rng.normal(size=(900, 16))))
    v[7] = 0
    norms = np.sqrt((v ** 2).sum(axis=1))
    directions = hn.reference_directions(list(v[:200]))
    angles = hn._angles(v, norms, directions)
    block = hn.Block(np.arange(100), np.zeros(100, int), v[:100], norms[:100], angles[:100],
                     np.full((100, 1), -np.inf), np.full((100, 1), np.inf), True, 5)
    low, high = hn.score_bounds(block, np.arange(100), norms, angles)
    exact = v[:100] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    search = hn.Search(block)
    search.add(np.arange(900), np.zeros(900, int), v, norms, angles)
    again = search.scored
    search.add(np.arange(900), np.zeros(900, int), v, norms, angles)
    assert search.scored - again < 100 * 900 / 3            # best scores are known now


def test_negatives_edge_tables(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert hn.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], schema)).collect() == []
    given = [(0, 1, [1e300, 1.0]), (50, 1, [1e6, 1.0]), (1, 1, [2e6, 0.0]), (2, 2, [1.5e6, 0.0]),
             (3, 2, [1e308, 0.0])]
    df = spark.createDataFrame(given, schema).select(
        "*", *[F.lit("clash").alias(c) for c in ("id", "vector", "norm", "angles", "score", "rank", "slot")])
    # scores beyond a long are all its largest value, and tie
    assert hn.hard_negatives(df).collect() == [(50, 1, 1, 2, 65536 * 2 * 10 ** 12, 65536 * 15 * 10 ** 11)]


def test_negatives_query(spark):
    from tunedata.llm.registry import QUERIES
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    given = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in e]
    assert Counter(map(tuple, QUERIES["op11_angular_negatives"](spark, SF01).collect())) == plain_negatives(given)


# ---- shingle join --------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def plain_components(given):
    """(id, text) rows; every pair of different sets is compared."""
    sets = sorted({plain_set(t) for _, t in given} - {frozenset()}, key=lambda s: sorted(s))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    up[top(i)] = top(j)
    at = {s: top(i) for i, s in enumerate(sets)}
    least = {}
    for i, t in given:
        s = plain_set(t)
        if s and i is not None:
            least[at[s]] = min(i, least.get(at[s], i))
    return Counter((i, len(plain_set(t)), least.get(at[plain_set(t)]) if plain_set(t) else i) for i, t in given)


def drifted(rng, base, vocabulary, edits):
    out = list(base)
    for k in rng.sample(range(len(out)), edits):
        out[k] = rng.choice(vocabulary)
    return " ".join(out)


def families(seed):
    """Copies at all distances around the threshold, a passage that many texts
    share, chains in which only neighbours link, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for size, words in ((150, 120), (60, 200), (8, 30), (8, 9), (2, 5)):
        base = rng.choices(vocabulary, k=words)
        out += [drifted(rng, base, vocabulary, rng.randrange(0, max(2, words // 15))) for _ in range(size)]
    chain = rng.choices(vocabulary, k=150)
    for _ in range(40):
        out.append(" ".join(chain))
        for k in rng.sample(range(150), 3):
            chain[k] = rng.choice(vocabulary)
    out += [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)) + passage) for _ in range(120)]
    out += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(80)]
    out += [out[3]] * 30 + [out[3].upper().replace(" ", "\n\t")] * 2
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("group,queries", [(32, 256), (3, 4)])
def test_components_equal_brute_force(spark, monkeypatch, group, queries):
    monkeypatch.setattr(grouped, "GROUP_ITEMS", group)
    monkeypatch.setattr(grouped, "QUERIES", queries)
    given = families(group)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, sj.shingle_links(df).collect()))
    assert got == plain_components(given)
    assert len({r[2] for r in got}) > 200


def test_components_edge_rows(spark):
    given = [(i, t) for i, t, *_ in rows()] + [(9, LONG + " end"), (11, None), (None, "ONE")]
    docs = edge_docs(spark).select("doc_id", "text", *[F.lit("x").alias(c) for c in (
        "id", "digest", "n", "probe", "least", "token", "at", "grp", "label", "component_id")])
    more = spark.createDataFrame(given[-3:], "doc_id long, text string").select(
        "*", *[F.lit("x").alias(c) for c in docs.columns[2:]])
    got = Counter(map(tuple, sj.shingle_links(docs.unionByName(more)).collect()))
    assert got == plain_components(given)
    assert sj.shingle_links(empty_docs(spark)).collect() == []


def test_candidates_of_a_family_grow_with_its_texts(spark):
    """Texts opened per group follow the family, not its square."""
    made = []
    for size in (100, 400):
        rng = random.Random(5)
        vocabulary = [f"w{i}" for i in range(100_000)]
        base = rng.choices(vocabulary, k=150)
        given = [(i, drifted(rng, base, vocabulary, rng.randrange(1, 14))) for i in range(size)]
        counted = []

        def counting(candidates, sets, groups, plain=sj.opened_links):
            counted.append(candidates.count())
            return plain(candidates, sets, groups)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sj, "opened_links", counting)
            got = sj.shingle_links(spark.createDataFrame(given, "doc_id long, text string")).collect()
        assert Counter(map(tuple, got)) == plain_components(given)
        made.append(sum(counted))
    assert made[0] <= 100 and made[1] <= 400


def test_group_bound_leaves_sets_closed():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 3, 6)]
    group = sj.Group(sets)
    assert group.links(np.arange(5, 105, dtype=np.uint64)).tolist() == [True, True, True]
    assert group.links(np.arange(90, 190, dtype=np.uint64)).tolist() == [False] * 3
    assert group.links(np.arange(7, 107, dtype=np.uint64)).tolist() == [True, True, True]
    assert group.links(np.arange(9, 109, dtype=np.uint64)).tolist() == [False, True, True]
    assert group.parts([b"a", b"b", b"c"]) == [b"a"] * 3

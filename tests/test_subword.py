"""Subword tokens against a naive merge loop, a public library and round trips."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tunedata.operators import subword as SW

TEXTS = [None, "", " ", "a", "I'll don't we've it's", "  two  blanks\n\n\tand  tabs \n", "naïve café — “quotes”…",
         "日本語のテキスト 123 456abc", "😀😃 x😀", "x" * 5000, " " * 300 + "end", "trailing   ", "  a　b\r\n",
         "'S 'LL ''s", "<|endoftext|> is text", "áé \x1c\x1d\x0b\x0c", "0" * 77 + " ٣٤٥ ½"]


@pytest.fixture(scope="module")
def ranks(spark):
    return SW.load_ranks(SW.read_ranks(spark))


def mixed(seed, count):
    rng = random.Random(seed)
    letters = "abcdeé日😀 \n\t'sS1٣.,— "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(count)]


def naive(piece, ranks):
    part = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[part[i] + part[i + 1]], i) for i in range(len(part) - 1)
                    if part[i] + part[i + 1] in ranks), default=None)
        if best is None:
            return part
        i = best[1]
        part[i:i + 2] = [part[i] + part[i + 1]]


def test_merges_like_the_definition(ranks):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aabcdeinrst é日") for _ in range(rng.randrange(1, 30))).encode()
        assert SW.merge(piece, ranks) == naive(piece, ranks)
    small = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"aab": 259}
    for n in range(1, 12):
        for piece in (b"a" * n, b"a" * n + b"b", b"ab" * n):
            assert SW.merge(piece, small) == naive(piece, small)
    long = b"ab" * 200_000                                # not the square of its length
    assert b"".join(SW.merge(long, ranks)) == long


def test_ids_of_the_public_library(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    public = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + mixed(2, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r.i: r for r in SW.encode(df, F.col("text"), ranks, ["i"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].input_ids == public.encode_ordinary(t or "")


def test_round_trip_and_offsets(spark, ranks):
    texts = TEXTS + mixed(3, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, given string")
    enc = SW.encode(df, F.col("given"), ranks, ["i", "given"])
    name = {i: t for t, i in ranks.items()}
    for r in SW.decode(enc, ranks).collect():
        assert r.text == (r.given or "")
        raw, at = (r.given or "").encode(), 0
        for x, a, b in zip(r.input_ids, r.starts, r.ends):
            covered = (r.given)[a:b].encode()
            assert name[x] in covered and len(name[x]) + 8 > len(covered)
            at += len(name[x])
        assert at == len(raw)
        assert not r.ends or (r.starts[0] == 0 and r.ends[-1] == len(r.given))


def test_limit_is_a_prefix(spark, ranks):
    df = spark.createDataFrame([(0, "word " * 50 + "x" * 300)], "i int, text string")
    whole = SW.encode(df, F.col("text"), ranks, ["i"]).first().input_ids
    for n in (1, 7, 50, 60, len(whole), len(whole) + 5):
        assert SW.encode(df, F.col("text"), ranks, ["i"], n).first().input_ids == whole[:n]


def test_a_token_across_the_border(spark, ranks):
    rows = [(0, "solve it", "self now"), (1, "end.", "Start"), (2, "", "only answer"), (3, "only problem", ""),
            (4, None, "a"), (5, "café", "é x"), (6, "pro", "blem"), (7, "a" * 40, "b")]
    df = spark.createDataFrame(rows, "record_id int, problem string, answer string")
    got = {r.record_id: r for r in SW.answer_labels(df, ranks).collect()}
    name = {i: t for t, i in ranks.items()}
    for i, p, a in rows:
        border, at, want = len((p or "").encode()), 0, []
        for x in got[i].input_ids:
            at += len(name[x])
            want.append(x if at > border else -100)
        assert got[i].labels == want and got[i].attention_mask == [1] * len(want)
    # "itself" is one token: it stands in both parts, so it is a label
    assert got[0].straddles == 1 and name[[x for x in got[0].labels if x >= 0][0]] == b" itself"
    assert got[6].straddles == 1 and got[6].labels == got[6].input_ids
    assert got[1].straddles == got[2].straddles == got[3].straddles == 0
    assert set(got[3].labels) == {-100}
    cut = SW.answer_labels(df, ranks, max_length=2).filter("record_id = 0").first()
    assert len(cut.labels) == 2


def test_uses_count_every_entry(spark, ranks):
    df = spark.createDataFrame([(0, [1, 1, 2]), (1, [1]), (2, [])], "i int, input_ids array<int>")
    got = {r.id: r for r in SW.token_uses(df, SW.read_ranks(spark), "i").collect()}
    assert len(got) == len(ranks)
    assert (got[1].uses, got[1].rows_with, got[2].uses, got[3].uses) == (3, 2, 1, 0)


def test_unfit_vocabularies(spark, monkeypatch):
    def table(rows):
        return spark.createDataFrame([(bytearray(p), i) for p, i in rows], "piece binary, id int")
    whole = [(bytes([b]), b) for b in range(256)]
    assert len(SW.load_ranks(table(whole))) == 256
    with pytest.raises(ValueError, match="lacks"):
        SW.load_ranks(table(whole[1:]))
    with pytest.raises(ValueError, match="twice"):
        SW.load_ranks(table(whole + [(b"ab", 5)]))
    with pytest.raises(ValueError, match="twice"):
        SW.load_ranks(table(whole + [(b"a", 256)]))
    monkeypatch.setattr(SW, "MOST_PIECES", 100)
    with pytest.raises(ValueError, match="large"):
        SW.load_ranks(table(whole))


def test_pattern_takes_every_character(spark):
    texts = [t for t in TEXTS + mixed(4, 200) if t]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", SW.pieces("text").alias("p")).collect():
        assert "".join(r.p) == r.text and all(re.search(r"(?s).", p) for p in r.p)


def test_a_piece_is_looked_up_once_for_all_texts():
    """Every occurrence went through Python on its own."""
    import pyarrow as pa
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, "\u00e9".encode(): 257}
    encoder = SW.Encoder(ranks)
    asked, real = [], encoder.piece
    encoder.piece = lambda p: asked.append(p) or real(p)
    rows = [["ab", "\u00e9a"] * 2, None, [], ["ab"], ["c", "ab", "ab"]]
    ids, starts, ends = (x.to_pylist() for x in encoder.texts(pa.array(rows, pa.list_(pa.string())), 4))
    assert sorted(asked) == ["ab", "c", "\u00e9a"]
    assert ids == [[256, 257, 97, 256], [], [], [256], [99, 256, 256]]
    assert starts == [[0, 2, 3, 4], [], [], [0], [0, 1, 3]]
    assert ends == [[2, 3, 4, 6], [], [], [2], [1, 3, 5]]

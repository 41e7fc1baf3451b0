"""Vocabulary, truncation, label windows, padding."""
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.operators import tokens as TK


def _vocab(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "text STRING")
    return TK.build_vocab(df.select(TK.tokenize("text").alias("tokens")), "tokens", cap=100)


def test_tokenize_and_vocab(spark):
    df = spark.createDataFrame([("Hello, wörld 12_a!",), ("",)], "text STRING")
    toks = [r[0] for r in df.select(TK.tokenize("text")).collect()]
    assert toks == [["Hello", ",", "wörld", "12_a", "!"], []]
    v = {r.token: r.id for r in _vocab(spark, ["b a a", "c b a"]).collect()}
    assert v == {"a": 4, "b": 5, "c": 6}         # count desc, then token; ids from 4
    capped = TK.build_vocab(spark.createDataFrame([(["x", "y", "y"],)], "tokens ARRAY<STRING>"),
                            cap=1)
    assert [(r.token, r.id) for r in capped.collect()] == [("y", 4)]


def test_encode_truncates_and_maps_unknown(spark):
    vocab = _vocab(spark, ["a b"])
    df = spark.createDataFrame([(1, "a b zz a"), (2, "")], "k INT, text STRING")
    enc = {r.k: r.input_ids for r in TK.encode(df, TK.tokenize("text"), vocab, "k", 3).collect()}
    assert enc == {1: [4, 5, T.UNK_ID], 2: []}
    eos = {r.k: r.input_ids for r in
           TK.encode(df, TK.tokenize("text"), vocab, "k", 5, add_eos=True).collect()}
    assert eos[1] == [4, 5, 1, 4, T.EOS_ID]


def test_labels_v2_window_inside_long_problem(spark):
    problem = " ".join(["p"] * 600)
    answer = " ".join(["q"] * 10)
    recs = spark.createDataFrame([(1, problem, answer)], "record_id INT, problem STRING, answer STRING")
    vocab = _vocab(spark, ["p q"])
    r = TK.labels_v2(recs, vocab).first()
    assert len(r.input_ids) == 610 == len(r.labels) == len(r.attention_mask)
    lab = r.labels
    assert all(x == T.IGNORE_INDEX for x in lab[:512])
    assert lab[512:522] == r.input_ids[512:522]       # window starts at 512, inside the problem
    assert all(x == T.IGNORE_INDEX for x in lab[522:])


def test_labels_v2_long_pair_cut(spark):
    recs = spark.createDataFrame([(1, " ".join(["p"] * 500), " ".join(["q"] * 3000))],
                                 "record_id INT, problem STRING, answer STRING")
    r = TK.labels_v2(recs, _vocab(spark, ["p q"])).first()
    assert len(r.input_ids) == 2048 == len(r.labels)
    assert r.labels[:500] == [T.IGNORE_INDEX] * 500
    assert r.labels[500:1012] == r.input_ids[500:1012]
    assert set(r.labels[1012:]) == {T.IGNORE_INDEX}


def test_pad_batches_left_multiple_of_8(spark):
    rows = [(i, list(range(1, n + 1)), list(range(1, n + 1)), i // 2)
            for i, n in enumerate([3, 9, 1, 8])]
    df = spark.createDataFrame(rows, "k INT, input_ids ARRAY<INT>, labels ARRAY<INT>, batch_id INT")
    out = {r.k: r for r in TK.pad_batches(df).collect()}
    assert out[0].width == 16 and len(out[0].input_ids) == 16
    assert out[0].input_ids[:13] == [0] * 13 and out[0].input_ids[13:] == [1, 2, 3]
    assert out[0].attention_mask == [0] * 13 + [1] * 3
    assert out[0].labels[:13] == [-100] * 13
    assert out[2].width == 8 and out[3].width == 8


def test_length_batches_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 37).alias("len"))
    b = TK.length_batches(df, "len", "k", batch_size=4, mega=50)
    sizes = [r.n for r in b.groupBy("batch_id").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) == 4 and len(sizes) == 250
    w = TK.padding_waste(df, "len", "k").first()
    assert w.grouped_waste < w.ungrouped_waste


def test_step_budget(spark):
    r = TK.step_budget(spark.range(1000)).first()
    assert (r.rows, r.rows_seen, r.rows_unseen) == (1000, 8000, 0) and r.epochs == 8.0


def test_vocab_threshold_with_ties_and_large_cap(spark):
    toks = spark.createDataFrame([(["a", "a", "a", "d", "d", "c", "c", "b", "b", "e"],)],
                                 "tokens ARRAY<STRING>")
    two = [(r.token, r.id) for r in TK.build_vocab(toks, cap=2).orderBy("id").collect()]
    assert two == [("a", 4), ("b", 5)]                      # cap falls inside the count-2 tie
    allv = [(r.token, r.id) for r in TK.build_vocab(toks, cap=100).orderBy("id").collect()]
    assert allv == [("a", 4), ("b", 5), ("c", 6), ("d", 7), ("e", 8)]

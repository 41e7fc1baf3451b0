"""Rows that once got lost, merged, piled up in one task or went stale."""
import os
import pathlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunedata import session
from tunedata.functions import templates as T
from tunedata.operators import generate as G
from tunedata.operators import lookup
from tunedata.operators import metrics as M
from tunedata.operators import preference as D
from tunedata.operators import sampling as R
from tunedata.operators import tokens as TK
from tunedata.operators.rank import hash_rank, key_rank, range_rank
from tunedata.plans import builds as W
from tunedata.sources import io as IO
from tunedata.sources import views as V
from tunedata.streaming.generate import stream_generate


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.coalescePartitions.enabled")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys[:2]:
        spark.conf.set(k, "-1")
    spark.conf.set(keys[2], "false")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_partition(df):
    per = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in per)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k INT, x STRING")
    pos = {r.k: r.position for r in R.shuffle_positions(df, "k").collect()}
    assert sorted(pos.values()) == [1, 2, 3] and pos[None] == 3
    split = R.train_val_split(df, "k", test_size=0.4).collect()
    assert Counter(r.split for r in split) == {"validation": 2, "train": 1}
    assert sorted(r["rank"] for r in key_rank(df, "k").collect()) == [1, 2, 3]
    flags = spark.createDataFrame([(1, True), (2, None), (3, None)], "k INT, f BOOLEAN")
    ranks = hash_rank(flags, 0, "k", by=("f",)).collect()
    assert sorted((r.f is None, r["rank"]) for r in ranks) == [(False, 1), (True, 1), (True, 2)]


def test_range_rank(spark):
    rows = [(i * 7919 % 1000, i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "a INT, b INT").repartition(5)
    got = {(r.a, r.b): r["rank"] for r in
           range_rank(df, [F.desc("b"), F.asc("a")]).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {r: i + 1 for i, r in enumerate(want)}


def test_vocabulary_keeps_every_token(spark):
    words = [f"t{i}" for i in range(3000)] + ["t5", "t7", "t7"]
    df = spark.createDataFrame([(words,)], "tokens ARRAY<STRING>")
    got = {r.token: r.id for r in TK.build_vocab(df).collect()}
    count = Counter(words)
    want = sorted(count, key=lambda t: (-count[t], t))
    assert got == {t: i + 4 for i, t in enumerate(want)}


def test_encode_by_parts_like_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(TK, "HEAD_TOKENS", 3)
    df = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(40))) for i in range(30)]
                               + [(99, ""), (98, None)], "k INT, text STRING")
    toks = df.select("k", TK.tokenize("text").alias("tokens"))
    vocab = TK.build_vocab(toks.where("k < 20"))
    by = [{r.k: r.input_ids for r in TK.encode(toks, F.col("tokens"), vocab, "k", 25,
                                               broadcast_bytes=b).collect()} for b in (1 << 20, 0)]
    assert by[0] == by[1] and len(by[0]) == 32 and by[0][99] == []


def test_encode_refuses_shared_keys(spark):
    vocab = TK.build_vocab(spark.createDataFrame([(["a", "b"],)], "tokens ARRAY<STRING>"))
    for texts in (("a b", "b"), ("", "")):
        df = spark.createDataFrame([(1, t) for t in texts], "k INT, text STRING")
        with pytest.raises(Exception, match="several rows share one k"):
            TK.encode(df, TK.tokenize("text"), vocab, "k", 5).collect()


def test_eos_is_last_also_when_cut(spark):
    vocab = TK.build_vocab(spark.createDataFrame([(["a"],)], "tokens ARRAY<STRING>"))
    df = spark.createDataFrame([(1, "a a a a"), (2, "")], "k INT, text STRING")
    got = {r.k: r.input_ids for r in TK.encode(df, TK.tokenize("text"), vocab, "k", 3,
                                               add_eos=True).collect()}
    assert got == {1: [4, 4, T.EOS_ID], 2: [T.EOS_ID]}


def test_real_problem_folders(spark, tmp_shared):
    root = pathlib.Path(tmp_shared("a root with blanks"))
    texts = {"a b": "one", "x=1": "two", "y=1": "three", "p+q": "four", "50%25": "five", "ü": " six\r\n"}
    for name, text in texts.items():
        (root / name).mkdir(parents=True)
        (root / name / "question.txt").write_text(text, newline="")
        (root / name / "solutions.json").write_text("[]")
        (root / name / "nested").mkdir()
        (root / name / "nested" / "question.txt").write_text("too deep")
    (root / "empty").mkdir()
    (root / "other").mkdir()
    (root / "other" / "metadata.json").write_text("{}")
    got = {r.problem_id: r.text for r in IO.read_problem_dirs(spark, str(root)).collect()}
    assert got == {k: v.strip() for k, v in texts.items()}


def test_failed_rejections_keep_their_row(spark, tmp_shared):
    recs = spark.createDataFrame([(1, "p", "fine", "Original"), (2, "p", "bad", "Ambiguous"),
                                  (3, "p", "empty", "Ambiguous")],
                                 "record_id INT, problem STRING, answer STRING, type STRING")
    log = tmp_shared("calls")
    os.makedirs(log)

    def backend(prompt):
        import uuid
        open(f"{log}/{uuid.uuid4()}", "w").close()
        if "bad" in prompt:
            raise RuntimeError("no")
        return "" if "empty" in prompt else "worse"

    got = D.preference_pairs(recs, backend=backend, path=tmp_shared("reject"), with_status=True)
    rows = {r.record_id: (r.rejected, r.status) for r in got.collect()}
    assert rows == {1: ("worse", "ok"), 2: (D.EMPTY_REJECTED, "error"), 3: (D.EMPTY_REJECTED, "ok")}
    assert got.count() == 3 and len(os.listdir(log)) == 3      # read twice, asked once


def test_append_null_keys_once(spark, tmp_shared):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k INT, x STRING")
    path = tmp_shared("append")
    for _ in range(3):
        out = IO.append_dataset(spark, path, rows, "k")
    assert out.count() == 2


def _records(spark, n_original, n_other):
    return spark.range(n_original + n_other).select(
        F.col("id").alias("record_id"), F.lit("p").alias("problem"),
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer"),
        F.when(F.col("id") < n_original, "Original").otherwise("Ambiguous").alias("type"))


def test_one_class_gives_no_pairs(spark):
    assert D.cross_class_rejected(_records(spark, 0, 20)).count() == 0
    assert D.cross_class_rejected(_records(spark, 20, 0)).count() == 0


def test_tiny_class_is_spread(spark, no_broadcast):
    recs = _records(spark, 1, 20_000)
    out = D.cross_class_rejected(recs)
    assert largest_partition(out) < 6_000
    assert out.count() == 20_001
    assert out.where("type = 'Ambiguous'").select("rejected").distinct().collect()[0][0] == "a0"
    few = D.cross_class_rejected(recs, rows_per_salt=10 ** 9)
    key = lambda df: Counter((r.record_id, r.rejected_id) for r in df.collect())
    assert key(few) == key(out)


def test_tiny_class_oversampled_is_spread(spark, no_broadcast):
    one = spark.createDataFrame([(5, "x")], "k INT, text STRING")
    out = R.oversample(one, 50_000, "k")
    assert out.count() == 50_000 and largest_partition(out) < 20_000
    both = _records(spark, 1, 30_000)
    balanced = R.balance(both, "record_id", (50, 50), "oversample")
    assert balanced.where("is_original").count() == 30_000
    assert largest_partition(balanced) < 25_000


def test_unknown_cap_is_refused(spark):
    with pytest.raises(ValueError, match="cap"):
        R.sample_plan(R.class_split(_records(spark, 1, 1)), cap="theirs")


def test_empty_answers_are_repaired(spark, tmp_shared):
    seen = tmp_shared("first")
    os.makedirs(seen)

    def backend(prompt):
        import hashlib
        mark = f"{seen}/{hashlib.md5(prompt.encode()).hexdigest()}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            return ""
        return "answer to " + prompt[-5:]

    probs = spark.createDataFrame([(1, "One thing. Two things."), (2, "Three things.")],
                                  "problem_id INT, text STRING")
    out = W.build_dataset(probs, backend=backend, workdir=tmp_shared("w1")).collect()
    assert len(out) == 2 * len(T.KINDS) and all(r.answer and r.problem for r in out)
    none = W.build_dataset(probs, backend=lambda p: "", workdir=tmp_shared("w2")).collect()
    assert none == []


def test_batches_hold_both_halves(spark):
    recs = spark.range(53).select(
        F.col("id").alias("record_id"), F.expr("repeat('a b ', cast(id % 9 as int))").alias("problem"),
        F.lit("c d").alias("answer"), F.lit("Original").alias("type"))
    for variant in (1, 2, 3, 4):
        got = W.build_batches(recs, variant=variant).collect()
        assert Counter(r.split for r in got) == {"validation": 11, "train": 42}
        per = Counter((r.split, r.batch_id) for r in got)
        assert max(per.values()) == 4
        assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == r.width for r in got)
    with pytest.raises(ValueError):
        W.build_batches(recs, variant=5)


def test_changed_source_is_seen(spark, tmp_shared):
    import shutil
    from conftest import SF001, SF01
    folder = pathlib.Path(tmp_shared("sf"))
    folder.mkdir(parents=True)
    for source in (SF001, SF01):
        shutil.copy(f"{source}/conversations.parquet", folder / "conversations.parquet")
        os.chmod(folder / "conversations.parquet", 0o644)
        spark.catalog.clearCache()
        got = V.records(spark, f"file://{folder}").count()
        assert got == V.records(spark, source).count()


def test_long_conversations_have_distinct_records(spark, tmp_shared):
    folder = tmp_shared("sf")
    spark.range(4000).select(
        (F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"),
        F.when(F.floor(F.col("id") / 2) % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.lit("t").alias("text")).write.parquet(f"{folder}/conversations.parquet")
    got = V.records(spark, folder)
    assert got.count() == 2000 == got.select("record_id").distinct().count()


def test_shared_folder_is_asked_for_on_clusters(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        def getConf(self): return Conf()
        def getCheckpointDir(self): return None

    class Session:
        conf = Conf()

    monkeypatch.setattr(session, "_context", lambda s: Context())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_stream_counts_all_batches(spark, tmp_shared):
    req = G.request_table(spark.range(12).select(
        F.lit("ambiguous").alias("kind"), F.col("id").cast("string").alias("prompt"),
        F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text")), "rewrite").drop("params")
    src, sink, ck = (tmp_shared(n) for n in ("req", "resp", "ck"))
    for i in range(4):
        req.where(F.col("prompt") % 4 == i).coalesce(1).write.mode("append").parquet(src)
    assert stream_generate(spark, src, req.schema, sink, ck, max_files_per_trigger=1) == 4
    assert stream_generate(spark, src, req.schema, sink, ck) == 0
    assert spark.read.parquet(sink).count() == 12


def test_json_documents_are_bounded(spark, tmp_shared):
    df = spark.range(400).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    path = tmp_shared("arrays")
    IO.write_json_arrays(df, path, "id", bytes_per_file=5_000)
    sizes = [p.stat().st_size for p in pathlib.Path(path).rglob("*.txt")]
    assert len(sizes) == 10 or len(sizes) > 6 and max(sizes) < 15_000
    assert IO.read_json_array(spark, path + "/*", df.schema).count() == 400


def test_perplexity_tail_lookup(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{j * i % 7}" for j in range(20))) for i in range(30)],
                               "k INT, text STRING")
    key = lambda d: {r.k: round(r.perplexity, 9) for r in d.collect()}
    want = key(M.perplexity(df, "k", "text"))
    monkeypatch.setattr(lookup, "HEAD_SHARE", 2.0)           # nothing is in the head
    assert key(M.perplexity(df, "k", "text")) == want


def test_index_needs_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k INT, output STRING")
    with pytest.raises(Exception, match="several rows share one k"):
        IO.index_nonempty(df, "k").collect()
    ok = spark.createDataFrame([(2, "a"), (None, "b"), (1, "")], "k INT, output STRING")
    assert {(r.k, r.idx) for r in IO.index_nonempty(ok, "k").collect()} == {(2, 1), (None, 2)}

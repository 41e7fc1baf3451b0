"""Plans (worked examples), exact sample sizes, permutations, determinism."""
import pytest
from pyspark.sql import functions as F

from tunedata.operators import rank as RK
from tunedata.operators import sampling as R


def _classes(spark, n_o, n_x):
    rows = [(i, "Original") for i in range(n_o)] + [(n_o + i, "Ambiguous") for i in range(n_x)]
    return spark.createDataFrame(rows, "record_id LONG, type STRING")


@pytest.mark.parametrize("ratio,exp", [((40, 60), (21912, 8764, 13147)),
                                       ((20, 80), (37370, 7474, 29896))])
def test_worked_example(spark, ratio, exp):
    df = spark.createDataFrame([(True,)] * 1 + [(False,)] * 1, "is_original BOOLEAN")
    counts = spark.createDataFrame([(8765, 29896)], "o LONG, x LONG")
    flagged = (counts.select(F.explode(F.array_repeat(F.lit(True), F.col("o").cast("int")))
                             .alias("is_original"))
               .unionByName(counts.select(F.explode(F.array_repeat(
                   F.lit(False), F.col("x").cast("int"))).alias("is_original"))))
    p = R.sample_plan(flagged, ratio).first()
    assert (p.total, p.original_target, p.other_target) == exp
    assert df.count() == 2


def test_zero_ratio_and_bad_mode(spark):
    df = _classes(spark, 3, 3).withColumn("is_original", R.is_original())
    with pytest.raises(ValueError):
        R.sample_plan(df, (0, 100))
    with pytest.raises(ValueError):
        R.sample_plan(df, (40, 60), mode="bogus")


def test_tiny_class_truncation(spark):
    b = R.balance(_classes(spark, 1, 100), "record_id", (40, 60), "downsample", seed=1)
    got = {r.is_original: r.n for r in b.groupBy("is_original").agg(F.count("*").alias("n")).collect()}
    assert got.get(True, 0) == 0 and got[False] == 1


def test_downsample_subset_no_repeats(spark):
    df = _classes(spark, 50, 70)
    d = R.downsample(df, 30, "record_id", seed=9)
    ids = [r.record_id for r in d.collect()]
    assert len(ids) == 30 == len(set(ids))
    assert R.downsample(df, 500, "record_id").count() == 120


def test_oversample_exact_size_known_rows(spark):
    df = _classes(spark, 0, 7)
    o = R.oversample(df, 100, "record_id", seed=4).collect()
    assert len(o) == 100
    assert {r.record_id for r in o} <= set(range(7))
    assert sorted(r.sample_id for r in o) == list(range(1, 101))


def test_balance_oversample_grows_minority(spark):
    b = R.balance(_classes(spark, 10, 100), "record_id", (40, 60), "oversample", seed=2)
    got = {r.is_original: r.n for r in b.groupBy("is_original").agg(F.count("*").alias("n")).collect()}
    assert got == {True: 66, False: 99}    # total = int(max(25, 166.67)) = 166; int(0.6*166)
    ref = R.balance(_classes(spark, 10, 100), "record_id", (40, 60), "oversample", seed=2,
                    cap="reference")
    assert ref.count() == 10 + 15           # upstream min(): never oversamples


def test_shuffle_is_permutation_and_partition_independent(spark):
    df = _classes(spark, 300, 700)
    out = {}
    for parts in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        pos = R.shuffle_positions(df.repartition(parts), "record_id", seed=5)
        out[parts] = {r.record_id: r.position for r in pos.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[1] == out[8] == out[64]
    assert sorted(out[1].values()) == list(range(1, 1001))


def test_rank_matches_sorted_md5(spark):
    import hashlib
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k: r.rank for r in RK.hash_rank(df, 42, "k").collect()}
    order = sorted(range(500), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert got == {k: i + 1 for i, k in enumerate(order)}


def test_key_rank_skewed_keys(spark):
    keys = [i * i * i for i in range(300)] + list(range(10 ** 9, 10 ** 9 + 200))
    df = spark.createDataFrame([(k,) for k in keys], "k LONG")
    got = {r.k: r.r for r in RK.key_rank(df, "k", name="r", buckets=16).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_split_sizes(spark):
    s = R.train_val_split(spark.range(101).withColumnRenamed("id", "k"), "k")
    sizes = {r.split: r.n for r in R.split_sizes(s).collect()}
    assert sizes == {"validation": 21, "train": 80}      # ceil(0.2 * 101)


def test_lead_in_group_matches_window(spark):
    from pyspark.sql import Window
    from tunedata.operators.windows import lead_in_group
    rows = [(1, t, f"r{t}") for t in list(range(0, 50)) + [77, 200, 201, 1000]] + \
           [(2, t, f"s{t}") for t in (5, 9)] + [(3, 0, "x")]
    df = spark.createDataFrame(rows, "g INT, o INT, v STRING")
    got = {(r.g, r.o): r.next_v for r in lead_in_group(df, "g", "o", ["v"], width=8).collect()}
    w = Window.partitionBy("g").orderBy("o")
    exp = {(r.g, r.o): r.n for r in df.select("g", "o", F.lead("v").over(w).alias("n")).collect()}
    assert got == exp


def test_write_shuffled_files_follow_positions(spark, tmp_shared):
    import glob
    import json
    path = tmp_shared("shuffled")
    df = R.shuffle_positions(_classes(spark, 40, 60), "record_id", seed=8)
    R.write_shuffled(df, path, partitions=4)
    seen = []
    for f in sorted(glob.glob(f"{path}/part-*.json")):
        seen += [json.loads(line)["position"] for line in open(f)]
    assert seen == list(range(1, 101))


def test_build_preferences_oversample_keys_draws(spark):
    from tunedata.plans.builds import build_preferences
    rows = [(i, f"p{i}", f"a{i}", "Original" if i < 5 else "Ambiguous") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id LONG, problem STRING, answer STRING, type STRING")
    out = build_preferences(df, ratio=(50, 50), mode="oversample", seed=1).collect()
    ids = [r.record_id for r in out]
    assert len(ids) == len(set(ids)) == 70                   # 35 + 35, Originals drawn again
    assert sum(r.type == "Original" for r in out) == 35
    assert all(r.rejected.startswith("a") for r in out)


def test_null_type_counts_as_other(spark):
    df = spark.createDataFrame([(1, "Original"), (2, None), (3, "original"), (4, "Ambiguous")],
                               "record_id LONG, type STRING")
    got = {r.record_id: r.is_original for r in R.class_split(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}      # case-sensitive, null -> other
    assert [r.record_id for r in R.filter_original(df).collect()] == [1]

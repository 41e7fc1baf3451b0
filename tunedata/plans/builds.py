"""Whole dataset builds composed from the operators (one lazy plan each).

W1 ``build_dataset``      problems -> variants -> clarifying questions ->
                          typed records (+ existing Original records) ->
                          seeded shuffle positions
W2 ``build_preferences``  balance Original vs other -> complete records ->
                          preference pairs with cross-class rejected answers
W3 ``build_batches``      instruction text -> tokens -> corpus vocabulary ->
                          ids + labels -> train / validation -> length-grouped,
                          left-padded batches
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.operators import generate as G
from tunedata.operators import prompts as P
from tunedata.operators import sampling as R
from tunedata.operators import tokens as TK
from tunedata.operators.preference import cross_class_rejected
from tunedata.session import default_parallelism, materialize, scratch_path

#: Positions of so many records at most are held in one array (a power of two).
PART_ROWS = 1 << 20


def build_dataset(problems: DataFrame, originals: DataFrame | None = None,
                  key: str = "problem_id", text: str = "text", kinds=T.KINDS,
                  backend="rules", seed: int = 0, workdir: str | None = None,
                  repairs: int = 1) -> DataFrame:
    """(record_id, problem, answer, type, position).

    Empty answers of the backend are asked again up to ``repairs`` times per
    run and stage; a request that stays empty or fails gives no record (its
    last attempt stays in the response table, and a rerun asks again).

    ``record_id`` is ``<kind>:<problem id>`` for generated rows and
    ``original:<id>`` for rows of ``originals`` (record_id, problem, answer).

    Each generation stage's responses and the final records are persisted
    under ``workdir`` (default: a fresh folder under the shared checkpoint
    dir): a rerun with the same ``workdir`` resumes (only pending requests
    are sent), the backend is called once per distinct request, and the
    shuffle ranks read a written table instead of recomputing the lineage.

    Texts stay where they are: the answers carry what the next step reads, in
    the order of the problems, and what is shuffled are ids and ranks. Only
    requests that several rows share are joined back to those rows.
    """
    spark = problems.sparkSession
    work = (workdir or scratch_path(spark, "build-dataset")).rstrip("/")
    probs = P.strip_text(problems.select(F.col(key).alias("problem_id"), F.col(text).alias("text")))
    rewrite = G.request_table(P.rewrite_prompt(P.expand_variants(probs, kinds)), "rewrite").withColumn(
        "record_id", F.concat(F.col("kind"), F.lit(":"), F.col("problem_id").cast("string")))
    answered = (F.col("status") == "ok") & (F.length("response") > 0)
    variants = G.repaired_at(rewrite, f"{work}/responses-rewrite", backend, repairs, carry=["kind", "record_id"]).where(
        answered).select(F.col("request_id").alias("rewrite_id"), "kind", "record_id", F.col(G.ALONE).alias("own"),
                         F.col("response").alias("text"))
    ask = P.question_prompt(variants).withColumn(
        "problem", P.unrender("prompt", "kind", T.QUESTION_TEMPLATES))
    qa = G.request_table(ask, "question")
    ok = G.repaired_at(qa, f"{work}/responses-question", backend, repairs,
                       carry=["kind", "record_id", "own", "problem"]).where(answered)
    cols = ["record_id", "problem", F.col("response").alias("answer"), F.initcap("kind").alias("type")]
    single = F.col("own") & F.col(G.ALONE)
    records = ok.where(single).select(*cols).unionByName(
        _shared(rewrite, qa, ok.where(~single)).select(*cols))
    if originals is not None:
        o = originals.select(
            F.concat(F.lit("original:"), F.col("record_id").cast("string")).alias("record_id"),
            "problem", "answer", F.lit(T.ORIGINAL).alias("type"))
        records = records.unionByName(o)
    return _positions_at(records, f"{work}/records", seed)


def _shared(rewrite: DataFrame, qa: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` to questions that several records share, or whose variant
    several do: a row for each of these records."""
    def of(column, name):
        return F.unhex(column).alias(name)               # half the bytes of an id
    asked = qa.select(of("rewrite_id", "rewrite"), of("request_id", "question"), "record_id", "own")
    links = rewrite.select(of("request_id", "rewrite"), "record_id").join(
        asked.where(~F.col("own")).select("rewrite", "question"), "rewrite").select("question", "record_id")
    links = links.unionByName(asked.where("own").select("question", "record_id"))
    texts = answers.select(of("request_id", "question"), "kind", "problem", "response")
    return links.join(texts, "question")


def _positions_at(records: DataFrame, path: str, seed: int) -> DataFrame:
    """``records`` written to ``path``, with their shuffle positions.

    The positions are worked out on the keys and come back to the rows: the
    table is bucketed by the task that wrote a row (``part``, of ``PART_ROWS``
    rows at most), each part's positions are an array in the order of its rows
    (``row``, the number that a row has in its part), and the join by part moves
    these and no text."""
    spark = records.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * default_parallelism(spark))
    name = f"records_{uuid.uuid4().hex}"
    # a task writes one bucket, or a few: its rows need not be sorted by bucket
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "4")
    # the task in the upper bits, the number of the row in the task in the lower ones
    numbered = records.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("part", F.expr(f"_id div {PART_ROWS}")).withColumn(
        "row", F.pmod("_id", F.lit(PART_ROWS)).cast("int")).drop("_id")
    try:
        (numbered.write.mode("overwrite").option("path", path).option("compression", "zstd").bucketBy(n, "part")
         .saveAsTable(name, format="parquet"))
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)
    rows = spark.table(name)
    ranks = R.shuffle_positions(rows.select("record_id", "part", "row"), "record_id", seed)
    parts = ranks.select("part", "row", "position").repartition(n, "part").groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "position"))), lambda r: r["position"]).alias("_all"))
    placed = rows.join(parts.hint("shuffle_hash"), "part").withColumn("position", F.get("_all", "row"))
    spark.sql(f"DROP TABLE {name}")                      # the name alone: the files are at path
    return placed.drop("part", "row", "_all")


def build_preferences(records: DataFrame, key: str = "record_id", ratio=(20, 80),
                      mode: str = "downsample", seed: int = 0) -> DataFrame:
    balanced = R.balance(records, key, ratio, mode, seed)
    # written once: the pairing reads it three times
    balanced = materialize(balanced, "balanced")
    cols = [key, "problem", "answer", "type"]
    if mode == "oversample":
        # the same record may be drawn several times: key the draws
        balanced = balanced.withColumn(key, F.concat_ws("#", F.col(key).cast("string"),
                                                        F.col("sample_id").cast("string")))
    return cross_class_rejected(balanced.select(*cols), key, seed)


def _variant(records: DataFrame, variant: int, key: str) -> tuple[DataFrame, list[str], int]:
    """Tokens of each record under tokenizer variant 1-4, with the columns its
    labels need, and its length limit."""
    if variant == 2:
        rows = records.select(key, TK.tokenize("problem").alias("_p"), TK.tokenize("answer").alias("_a"))
        return rows.select(key, F.concat("_p", "_a").alias("tokens"),
                           F.least(F.size("_p"), F.lit(512)).alias("s"),
                           F.least(F.size("_a"), F.lit(512)).alias("a")), ["s", "a"], 2048
    text = {1: P.concat_v1, 3: P.concat_v3, 4: P.concat_v4}[variant]()
    texts = records.select(key, text.alias("_text"))
    return texts.select(key, TK.tokenize("_text").alias("tokens")), [], 2048 if variant == 4 else 512


def build_batches(records: DataFrame, key: str = "record_id", seed: int = 42, variant: int = 4,
                  batch_size: int = 4, mega: int = 50, test_size: float = 0.2,
                  vocab_cap: int | None = None) -> DataFrame:
    """Texts of tokenizer ``variant`` 1-4 -> padded batches of both halves:
    ``split`` is 'train' or 'validation', ``batch_id`` counts within it.

    The seeded order is ranked once, from the keys alone (small rows), and
    joined to the encoded rows, which the encoding already partitioned by key.
    Validation is ranks ``<= ceil(test_size * n)``; a train row's own rank is
    the global rank minus that cut (same seed, same order). So the wide id
    arrays are shuffled only by the encoding and by the mega-batch window,
    and padding reuses the latter."""
    if variant not in (1, 2, 3, 4):
        raise ValueError(f"variant must be 1, 2, 3 or 4, got {variant!r}")
    toks, carry, limit = _variant(records, variant, key)
    vocab = TK.build_vocab(toks, "tokens", vocab_cap)
    enc = TK.encode(toks, F.col("tokens"), vocab, key, limit, carry=carry)
    enc = TK.answer_only_labels(enc).drop("s", "a") if variant == 2 else TK.causal_labels(enc)
    order = R.hash_rank(records.select(key), seed, key, name="_rk")
    cut = records.agg(F.ceil(F.lit(float(test_size)) * F.count(F.lit(1))).alias("_cut"))
    validation = F.col("_rk") <= F.col("_cut")
    rows = (enc.join(order, key).crossJoin(F.broadcast(cut))      # cut: one row
            .withColumn("split", F.when(validation, "validation").otherwise("train"))
            .withColumn("_own", F.when(validation, F.col("_rk")).otherwise(F.col("_rk") - F.col("_cut")))
            .withColumn("_len", F.size("input_ids")))
    batched = TK.length_batches(rows, "_len", key, seed, batch_size, mega, keep_mega=True,
                                rank="_own", within=("split",))
    # batches never cross mega-batches: pad inside the existing partitioning
    return TK.pad_batches(batched, within=("split", "mega_id")).select(
        key, "split", "batch_id", "width", "input_ids", "attention_mask", "labels")

"""Tokenization, corpus vocabulary, encoding, label masks and batching.

Stand-in for a pretrained BPE tokenizer: word/punctuation tokens
(``functions.text.TOKEN_PATTERN``) and a vocabulary *built by Spark* from the
corpus, with the reference's truncation / masking / padding semantics.

Scale notes
* ``build_vocab`` is a map-side-combined ``groupBy(token)`` and a distributed
  rank by (count, token); no token is dropped unless the caller sets ``cap``.
* ``encode`` truncates **before** exploding, so at most ``max_length`` rows per
  record are joined. A vocabulary of up to ``BROADCAST_BYTES`` (measured) is
  broadcast; the regrouping ``collect_list`` is then partially aggregated in
  the task that exploded the record. A larger one is looked up in two parts:
  its most frequent tokens (bounded bytes) by broadcast, the others by a
  shuffle join to which the rows already resolved come spread out evenly.
* Batch windows (``pad_batches``, ``length_batches``) are partitioned by batch
  or mega-batch ids, i.e. at most ``batch_size`` / ``mega * batch_size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.functions.text import col_, tokens as _tokens
from tunedata.operators.rank import hash_rank, range_rank
from tunedata.session import materialize

BROADCAST_BYTES = 32 << 20
HEAD_TOKENS = 50_000
HEAD_TOKEN_BYTES = 256       # longer tokens are never in the broadcast head


def tokenize(c: Column | str) -> Column:
    """Text -> array<string> tokens."""
    return _tokens(c)


# --- T2 ----------------------------------------------------------------------
def build_vocab(corpus_tokens: DataFrame, column: str = "tokens",
                cap: int | None = None) -> DataFrame:
    """token -> id by (count desc, token); ids 0-3 are pad/unk/bos/eos.

    All tokens of the corpus by default; ``cap`` keeps the most frequent ones.
    The result is a written table."""
    if cap is not None and cap <= 0:
        raise ValueError("vocabulary cap must be positive")
    counts = materialize(corpus_tokens.select(F.explode(F.col(column)).alias("token"))
                         .groupBy("token").agg(F.count(F.lit(1)).alias("count")), "vocab-counts")
    ranks = range_rank(counts, [F.desc("count"), F.asc("token")], "_rk")
    if cap is not None:
        ranks = ranks.where(F.col("_rk") <= cap)
    return materialize(ranks.select("token", (F.col("_rk") + T.EOS_ID).cast("int").alias("id"),
                                    "count"), "vocab")


def _token_ids(rows: DataFrame, vocab: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``rows`` with ``id`` of their ``token`` (null if unknown)."""
    v = vocab.select("token", "id")
    size = v.agg(F.sum(F.octet_length("token") + F.lit(24))).first()[0] or 0
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(v), "token", "left")
    # HEAD_TOKENS tokens of at most HEAD_TOKEN_BYTES: a bounded broadcast
    in_head = ((F.col("id") <= HEAD_TOKENS + T.EOS_ID)
               & (F.octet_length("token") <= HEAD_TOKEN_BYTES))
    head = v.where(in_head).select("token", F.col("id").alias("_hid"))
    tail = v.where(~in_head).select(F.col("token").alias("_tk"), F.col("id").alias("_tid"))
    found = rows.join(F.broadcast(head), "token", "left")
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(*rows.columns), F.lit(65_536)).cast("string"))
    # a resolved row needs no partner: its key only spreads it over the tasks
    keyed = found.withColumn("_jk", F.when(F.col("_hid").isNull(), F.col("token")).otherwise(spread))
    return (keyed.join(tail, keyed["_jk"] == tail["_tk"], "left")
            .withColumn("id", F.coalesce("_hid", "_tid")).drop("_jk", "_tk", "_hid", "_tid"))


# --- T3 ----------------------------------------------------------------------
def encode(df: DataFrame, token_array: Column, vocab: DataFrame, key: str,
           max_length: int, add_eos: bool = False, carry: Sequence[str] = (),
           out: str = "input_ids", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, *carry, out=array<int>) with ``out`` the first ``max_length`` ids
    (unknown token -> 1). With ``add_eos`` every row ends with the end id,
    which counts towards ``max_length``. ``carry`` columns must be small
    scalars: they ride along each token row. Two rows with one key are an
    error, found while the arrays are built."""
    carry = list(carry)
    cut = F.slice(token_array, 1, max_length - 1 if add_eos else max_length)
    rows = df.select(key, *carry, cut.alias("_cut"))
    ex = rows.select(key, *carry, F.size("_cut").alias("_size"),
                     F.posexplode_outer("_cut").alias("_pos", "token"))
    j = _token_ids(ex, vocab, broadcast_bytes)
    item = F.when(F.col("_pos").isNotNull(),
                  F.struct("_pos", F.coalesce(F.col("id"), F.lit(T.UNK_ID)).alias("id")))
    g = j.groupBy(key).agg(*[F.any_value(c).alias(c) for c in carry],
                           F.sort_array(F.collect_list(item)).alias("_p"),
                           F.count(F.lit(1)).alias("_rows"), F.max("_size").alias("_size"))
    unique = F.col("_rows") == F.greatest(F.col("_size"), F.lit(1))
    ids = F.when(unique, F.transform("_p", lambda x: x["id"])).otherwise(
        F.raise_error(F.lit(f"encode: several rows share one {key}")))
    if add_eos:
        ids = F.concat(ids, F.array(F.lit(T.EOS_ID)))
    return g.select(key, *carry, ids.alias(out))


# --- T4 / T5 -----------------------------------------------------------------
def causal_labels(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """labels = copy of input_ids; attention mask of ones."""
    return (df.withColumn("labels", F.col(ids))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids))))


def answer_only_labels(df: DataFrame, start: str = "s", length: str = "a",
                       ids: str = "input_ids") -> DataFrame:
    """labels[i] = ids[i] for start <= i < start + length, else -100."""
    s, a = F.col(start), F.col(length)
    lab = F.transform(ids, lambda x, i: F.when((i >= s) & (i < s + a), x)
                      .otherwise(F.lit(T.IGNORE_INDEX)))
    return (df.withColumn("labels", lab)
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids))))


def labels_v2(records: DataFrame, vocab: DataFrame, key: str = "record_id",
              problem: str = "problem", answer: str = "answer",
              part_cap: int = 512, max_length: int = 2048) -> DataFrame:
    """Answer-only labels: input = tok(problem) ++ tok(answer) cut at
    ``max_length``; loss window starts at ``min(len(tok(problem)), 512)`` and
    spans ``min(len(tok(answer)), 512)`` (may start inside a long problem)."""
    tp, ta = tokenize(problem), tokenize(answer)
    pre = records.select(key, F.least(F.size(tp), F.lit(part_cap)).alias("s"),
                         F.least(F.size(ta), F.lit(part_cap)).alias("a"),
                         F.concat(tp, ta).alias("_toks"))
    enc = encode(pre, F.col("_toks"), vocab, key, max_length, carry=["s", "a"])
    return answer_only_labels(enc).drop("s", "a")


# --- T6 ----------------------------------------------------------------------
def pad_batches(df: DataFrame, batch: str = "batch_id", multiple: int = 8,
                ids: str = "input_ids", labels: str = "labels",
                within: Sequence[str] = ()) -> DataFrame:
    """Left-pad every row to the batch width = batch max rounded up to a
    multiple of ``multiple``; pad id 0, labels -100, mask 0/1.

    ``within``: columns that already contain each batch (e.g. ``mega_id`` from
    ``length_batches``); the width window then reuses that partitioning
    instead of shuffling the id arrays again."""
    n = F.size(ids)
    part = Window.partitionBy(*within, batch)
    width = (F.ceil(F.max(n).over(part) / F.lit(float(multiple)))
             * multiple).cast("int")
    pad = F.col("_width") - n
    return (df.withColumn("_width", width).select(
        *[c for c in df.columns if c not in (ids, labels, "attention_mask")],
        F.concat(F.array_repeat(F.lit(T.PAD_ID), pad), F.col(ids)).alias(ids),
        F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), n)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(T.IGNORE_INDEX), pad), F.col(labels)).alias(labels),
        F.col("_width").alias("width")))


# --- T7 ----------------------------------------------------------------------
def length_batches(df: DataFrame, length: str, key: str, seed: int = 42,
                   batch_size: int = 4, mega: int = 50, keep_mega: bool = False,
                   rank: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Length-grouped batches: seeded shuffle -> mega-batches of
    ``mega * batch_size`` rows -> sort by length desc inside -> cut.
    ``keep_mega`` keeps ``mega_id`` (rows stay partitioned by it); ``rank``
    names an existing 1-based seeded rank column to use instead of ranking
    (and shuffling) the rows again; ``within``: columns whose values are
    batched apart (``rank`` counts within them)."""
    r = (hash_rank(df, seed, key, name="_rk") if rank is None
         else df.withColumn("_rk", F.col(rank)))
    m = F.floor((F.col("_rk") - 1) / F.lit(mega * batch_size)).cast("long")
    w = Window.partitionBy(*within, "mega_id").orderBy(F.desc(length), "_rk")
    out = (r.withColumn("mega_id", m)
           .withColumn("_j", F.row_number().over(w))
           .withColumn("batch_id", (F.col("mega_id") * mega
                                    + F.floor((F.col("_j") - 1) / F.lit(batch_size))).cast("long"))
           .drop("_rk", "_j"))
    return out if keep_mega else out.drop("mega_id")


def sequential_batches(df: DataFrame, key: str, seed: int = 42, batch_size: int = 4) -> DataFrame:
    """Ungrouped batches of the same seeded order (baseline for T8)."""
    r = hash_rank(df, seed, key, name="_rk")
    return r.withColumn("batch_id", F.floor((F.col("_rk") - 1) / F.lit(batch_size))
                        .cast("long")).drop("_rk")


# --- T8 ----------------------------------------------------------------------
def padding_waste(df: DataFrame, length: str, key: str, seed: int = 42,
                  batch_size: int = 4, mega: int = 50, multiple: int = 8) -> DataFrame:
    """Share of pad tokens with length grouping vs. without (one row)."""
    def waste(b: DataFrame, name: str) -> DataFrame:
        per = b.groupBy("batch_id").agg(
            (F.ceil(F.max(length) / F.lit(float(multiple))) * multiple * F.count(F.lit(1)))
            .alias("cells"), F.sum(length).alias("used"))
        return per.agg(F.round(F.try_divide(F.sum("cells") - F.sum("used"), F.sum("cells")), 6)
                       .alias(name), F.count(F.lit(1)).alias(f"{name}_batches"))
    g = waste(length_batches(df, length, key, seed, batch_size, mega), "grouped_waste")
    u = waste(sequential_batches(df, key, seed, batch_size), "ungrouped_waste")
    return g.crossJoin(u)   # 1 x 1 rows


# --- T9 ----------------------------------------------------------------------
def step_budget(df: DataFrame, steps: int = 500, per_device: int = 4,
                accumulation: int = 4) -> DataFrame:
    """Rows seen by ``steps`` optimizer steps, epochs, rows never seen."""
    seen = steps * per_device * accumulation
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.lit(seen).cast("long").alias("rows_seen"),
                  F.round(F.try_divide(F.lit(float(seen)), n), 6).alias("epochs"),
                  F.greatest(n - F.lit(seen), F.lit(0)).cast("long").alias("rows_unseen"))

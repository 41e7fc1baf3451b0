"""Profiling metrics: token lengths, word entropy, bigram perplexity.

Stand-ins: entropy uses the corpus tokenizer on lower-cased text instead of
a word tokenizer library; perplexity uses an add-one **bigram model trained by
Spark on the scored column** instead of a pretrained network, so its values
are relative to the corpus and must not be compared with model perplexities.

Scale notes
* Word entropy needs counts per distinct word of one text only: the text's
  token array is sorted and run-length counted with higher-order functions,
  so the metric is a narrow projection (no explode, no shuffle).
* Perplexity tokenizes each text once: its (previous, token) pairs are
  written, words as 64-bit hashes (of ten million different words two share one with a probability of 3e-6), and both the model and the scores start from that table. The model is two corpus-wide aggregates with map-side
  combine (``c(p, w)`` and ``c(p, .)``), a loss for each different pair, and a
  join to the texts' pairs that holds no hot key (``lookup.hot_lookup``).
  ``train_bigram`` writes the model tables for repeated scoring;
  ``perplexities`` trains one model per column in a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import col_, tokens
from tunedata.operators.lookup import hot_lookup
from tunedata.operators.prompts import concat_profile
from tunedata.session import materialize

START = "<s>"


def with_value_counts(df: DataFrame, sorted_arr: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<value, n: int>> with one entry per distinct
    value of the *sorted* array column ``sorted_arr`` (run lengths).

    Works on columns, never on expressions: a lambda that referenced an
    expression would re-evaluate it for every element, so the run starts are
    materialized in their own projection first (O(n) per row)."""
    s = F.col(sorted_arr)
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < n) & (
        (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
    st_col = f"_{out}_st"
    with_st = df.withColumn(st_col, starts)
    st = F.col(st_col)
    return with_st.withColumn(out, F.transform(st, lambda b, j: F.struct(
        F.get(s, b).alias("value"),
        (F.coalesce(F.get(st, j + 1), n) - b).alias("n")))).drop(st_col)


# --- M1 / M2 -----------------------------------------------------------------
def _profile_lengths(df: DataFrame, problem: str, answer: str) -> Column:
    return F.size(tokens(concat_profile(problem, answer)))


def token_length_stats(df: DataFrame, problem: str = "problem", answer: str = "answer") -> DataFrame:
    """avg / max / min tokens of ``problem + ' ' + answer``; no rows -> no row."""
    n = _profile_lengths(df, problem, answer)
    return (df.select(n.alias("_n"))
            .agg(F.count(F.lit(1)).alias("records"),
                 F.round(F.avg("_n"), 6).alias("avg_tokens"),
                 F.max("_n").cast("long").alias("max_tokens"),
                 F.min("_n").cast("long").alias("min_tokens"))
            .where(F.col("records") > 0))


def truncation_report(df: DataFrame, problem: str = "problem", answer: str = "answer",
                      limits=(512, 2048)) -> DataFrame:
    n = _profile_lengths(df, problem, answer)
    aggs = [F.count(F.lit(1)).alias("records")]
    for lim in limits:
        aggs.append(F.sum(F.when(F.col("_n") > lim, 1).otherwise(0)).cast("long")
                    .alias(f"over_{lim}"))
        aggs.append(F.round(F.avg(F.when(F.col("_n") > lim, 1.0).otherwise(0.0)), 6)
                    .alias(f"share_over_{lim}"))
    return df.select(n.alias("_n")).agg(*aggs).where(F.col("records") > 0)


# --- M3 ----------------------------------------------------------------------
def with_entropy(df: DataFrame, text: str, out: str = "entropy",
                 lowered: str | None = None) -> DataFrame:
    """Add ``-sum(p * ln(p + 1e-10))`` over the lower-cased words of ``text``
    ('' -> 0). Narrow: sort + run lengths per row, no shuffle. ``lowered``
    names a column that already holds those words."""
    words = F.col(lowered) if lowered else tokens(F.lower(F.col(text)))
    sorted_ = df.withColumn(f"_{out}_s", F.sort_array(words))
    counted = with_value_counts(sorted_, f"_{out}_s", f"_{out}_vc").withColumn(
        f"_{out}_n", F.size(f"_{out}_s"))
    total = F.col(f"_{out}_n")
    h = F.aggregate(f"_{out}_vc", F.lit(0.0), lambda acc, x: acc + (x["n"] / total)
                    * F.ln(x["n"] / total + F.lit(1e-10)))
    return counted.withColumn(out, F.when(total == 0, F.lit(0.0)).otherwise(-h)).drop(
        f"_{out}_s", f"_{out}_vc", f"_{out}_n")


# --- M4 ----------------------------------------------------------------------
def bigram_pairs(df: DataFrame, key: str, text: str, max_tokens: int = 1024,
                 source: str | None = None, lowered: str | None = None, hashed: bool = False) -> DataFrame:
    """(key, [src,] p, w, n): every (previous, token) pair of each text's
    first ``max_tokens`` lower-cased tokens (n = 1; texts repeat few pairs, and
    sorting a text's pairs to count them costs more than it saves). ``source``
    tags the pairs with the column they came from (several models in one pass);
    ``lowered`` names a column that holds the tokens; with ``hashed`` words are
    numbers, as ``_hashed`` makes them."""
    tag = [F.lit(source).alias("src")] if source is not None else []
    words = F.col(lowered) if lowered else tokens(F.lower(F.col(text)))
    words = F.slice(words, 1, max_tokens)
    t = df.select(key, *tag, (F.transform(words, lambda w: F.xxhash64(w)) if hashed else words).alias("_t"))
    tc = F.col("_t")
    start = F.xxhash64(F.lit(START)) if hashed else F.lit(START)
    prev = F.concat(F.array(start), F.slice(tc, 1, F.greatest(F.size(tc) - 1, F.lit(0))))
    zipped = F.when(F.size(tc) > 0, F.arrays_zip(prev.alias("p"), tc.alias("w")))
    # explode_outer + null filter: a plain explode makes Catalyst infer a
    # size(...) > 0 filter and push it (with the tokenizer) below this project
    ex = (t.select(key, *[F.col("src")] * bool(tag), F.explode_outer(zipped).alias("_v"))
          .where(F.col("_v").isNotNull()))
    return ex.select(key, *[F.col("src")] * bool(tag), F.col("_v.p").alias("p"),
                     F.col("_v.w").alias("w"), F.lit(1).cast("long").alias("n"))


def _hashed(table: DataFrame) -> DataFrame:
    """The words of a table of pairs or previous tokens as 64-bit hashes."""
    return table.withColumns({c: F.xxhash64(c) for c in ("p", "w") if c in table.columns})


def bigram_model(pairs: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by, p, w, c, rows) pair counts and in how many rows of ``pairs`` they
    are, (by, p, cp) previous-token totals and (by, v) vocabulary sizes; ``by``
    separates models trained in one pass. The pair counts are written once; the
    totals, written too, and sizes start from them."""
    by = list(by)
    c = materialize(pairs.groupBy(*by, "p", "w").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("rows")),
                    "bigram-counts")
    cp = materialize(c.groupBy(*by, "p").agg(F.sum("c").alias("cp")), "bigram-prevs")
    v = c.groupBy(*by).agg(F.countDistinct("w").alias("v"))
    return c, cp, v


def _pair_losses(counts: DataFrame, prevs: DataFrame, vocab: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p, w, rows, nll) of every pair of a model, written: one row a pair,
    however often it occurs."""
    by = list(by)
    size = F.broadcast(vocab)                                     # a row for each of ``by``
    sized = hot_lookup(counts, prevs, [*by, "p"], "cp", ["cp"])
    sized = sized.join(size, by) if by else sized.crossJoin(size)
    nll = -F.ln((F.col("c") + 1) / (F.col("cp") + F.col("v")))
    return materialize(sized.select(*by, "p", "w", "rows", nll.alias("nll")), "bigram-losses")


@dataclass(frozen=True)
class BigramModel:
    """Count tables of an add-one bigram model: ``pairs(p, w, c)``,
    ``prevs(p, cp)`` and the one-row ``vocab(v)``."""
    pairs: DataFrame
    prevs: DataFrame
    vocab: DataFrame


def train_bigram(corpus: DataFrame, key: str, text: str, max_tokens: int = 1024,
                 path: str | None = None) -> BigramModel:
    """Train once, score many times. With ``path`` (a shared folder) the
    tables are written there and read back, so scoring jobs reuse them
    instead of re-tokenizing the corpus."""
    c, cp, v = bigram_model(bigram_pairs(corpus, key, text, max_tokens))
    if path is None:
        return BigramModel(c, cp, v)
    spark = corpus.sparkSession
    base = path.rstrip("/")
    for name, df in (("pairs", c), ("prevs", cp), ("vocab", v)):
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    return load_bigram(spark, base)


def load_bigram(spark, path: str) -> BigramModel:
    base = path.rstrip("/")
    return BigramModel(*(spark.read.parquet(f"{base}/{n}") for n in ("pairs", "prevs", "vocab")))


def _no_tokens(text: str):
    # a text has no token iff it has no non-whitespace character (every such
    # character starts a token), so no second tokenizer pass is needed
    return ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\s]")


def perplexity(df: DataFrame, key: str, text: str, max_tokens: int = 1024,
               corpus: DataFrame | None = None, corpus_key: str | None = None,
               corpus_text: str | None = None, out: str = "perplexity",
               model: BigramModel | None = None) -> DataFrame:
    """(key, out): ``exp(mean -ln P(w | p))`` with
    ``P = (c(p,w) + 1) / (c(p,.) + V)``; NULL for a text without tokens.

    The model is ``model`` (see ``train_bigram``), else trained on ``corpus``,
    else on the scored column itself; pairs unseen in the model count 0."""
    pairs = materialize(bigram_pairs(df, key, text, max_tokens, hashed=True), "bigram-pairs")
    own = corpus is None and model is None
    if model is not None:
        c, cp, v = _hashed(model.pairs), _hashed(model.prevs), model.vocab
    else:
        train = pairs if corpus is None else bigram_pairs(
            corpus, corpus_key or key, corpus_text or text, max_tokens, hashed=True)
        c, cp, v = bigram_model(train)
    # a given model's pairs are common in the scored texts as in its own
    scored = hot_lookup(pairs, _pair_losses(c, cp, v), ["p", "w"], "rows", ["nll"])
    if not own:
        # an unseen pair can still have a known previous token
        scored = hot_lookup(scored, cp, ["p"], "cp", ["cp"]).crossJoin(F.broadcast(v))   # v: one row
        unseen = F.ln(F.coalesce(F.col("cp"), F.lit(0)) + F.col("v"))
        scored = scored.withColumn("nll", F.coalesce("nll", unseen))
    per = scored.groupBy(key).agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("_m"))
    got = per.select(key, F.exp("_m").alias(out))
    empty = df.where(_no_tokens(text)).select(key, F.lit(None).cast("double").alias(out))
    return got.unionByName(empty)


def perplexities(df: DataFrame, key: str, texts: dict[str, str], max_tokens: int = 1024,
                 lowered: dict[str, str] | None = None) -> DataFrame:
    """Several self-trained perplexities in one pass: ``texts`` maps output
    column -> text column; each column gets its own model (the column name is
    part of every model key), all pairs share one set of shuffles. ``lowered``
    maps output column -> column that holds its tokens."""
    pairs = None
    for out, text in texts.items():
        p = bigram_pairs(df, key, text, max_tokens, source=out, lowered=(lowered or {}).get(out), hashed=True)
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = materialize(pairs, "bigram-pairs")
    c, cp, v = bigram_model(pairs, by=("src",))
    scored = hot_lookup(pairs, _pair_losses(c, cp, v, ("src",)), ["src", "p", "w"], "rows", ["nll"])
    nll = F.col("nll")
    # one aggregate for all columns: a column without tokens gets NULL
    per = scored.groupBy(key).agg(*[
        F.exp(F.sum(F.when(F.col("src") == o, F.col("n") * nll))
              / F.sum(F.when(F.col("src") == o, F.col("n")))).alias(o) for o in texts])
    all_empty = F.lit(True)
    for t in texts.values():
        all_empty = all_empty & _no_tokens(t)
    empty = df.where(all_empty).select(key, *[F.lit(None).cast("double").alias(o)
                                              for o in texts])
    return per.unionByName(empty)


# --- M5 / M6 / M7 ------------------------------------------------------------
def record_metrics(df: DataFrame, key: str = "record_id", problem: str = "problem",
                   answer: str = "answer", max_tokens: int = 1024) -> DataFrame:
    """key, problem, answer + entropy and perplexity of both (rounded 4)."""
    # each column is tokenized once; entropy and pairs read the written arrays
    words = materialize(df.select(key, problem, answer,
                                  tokens(F.lower(F.col(problem))).alias("_pt"),
                                  tokens(F.lower(F.col(answer))).alias("_at")), "metric-tokens")
    base = with_entropy(with_entropy(words, problem, "problem_entropy", "_pt"),
                        answer, "answer_entropy", "_at").drop("_pt", "_at")
    base = (base.withColumn("problem_entropy", F.round("problem_entropy", 4))
            .withColumn("answer_entropy", F.round("answer_entropy", 4)))
    ppl = perplexities(words, key, {"problem_perplexity": problem, "answer_perplexity": answer},
                       max_tokens, {"problem_perplexity": "_pt", "answer_perplexity": "_at"})
    return (base.join(ppl, key, "left")
            .withColumn("problem_perplexity", F.round("problem_perplexity", 4))
            .withColumn("answer_perplexity", F.round("answer_perplexity", 4)))


def quality_summary(metrics: DataFrame) -> DataFrame:
    """Dataset macro-averages of the four per-record metrics."""
    return metrics.agg(*[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in (
        "problem_perplexity", "answer_perplexity", "problem_entropy", "answer_entropy")])


def type_counts(df: DataFrame, type_: str = "type") -> DataFrame:
    return df.groupBy(type_).agg(F.count(F.lit(1)).alias("n"))

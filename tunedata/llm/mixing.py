"""Mixing sources to target weights by Poisson replication.

Every document gets a hash-seeded uniform number; inverting the Poisson
distribution whose mean is the target repetition rate of its source gives the
number of copies. Documents are exploded by that count and shuffled globally.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, without, written

SEED = "mix-1"
#: A larger mean is split into equal parts, each with its own uniform number
#: (a sum of Poisson counts is a Poisson count), as exp(-mean) would vanish.
PART_MEAN = 16.0


def uniform(*parts: Column | str) -> Column:
    """52 bits of md5 over the parts joined with ':', in [0, 1)."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
            / F.lit(float(2 ** 52)))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, *,
                     key: str = "source", budget: float = 1.0) -> DataFrame:
    """One row per source: ``rows``, ``rate`` (mean copies of each of its
    documents), ``parts`` and the ``cdf`` of one part as an array.

    The mix has ``budget`` times as many rows as ``docs`` in the mean, shared
    out by ``weights`` (``key``, ``weight``); without it all sources weigh the
    same. A source that ``weights`` lacks, or with a weight that is null or not
    above 0, gets rate 0. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(key).alias("_mix_key")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        counts = counts.withColumn("_w", F.lit(1.0))
    else:
        named = (weights.groupBy(F.col(key).alias("_wk"))
                 .agg(F.max(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("_w")))
        counts = (counts.join(named, F.col("_mix_key").eqNullSafe(F.col("_wk")), "left")
                  .drop("_wk").withColumn("_w", F.coalesce("_w", F.lit(0.0))))
    total = counts.agg(F.sum("rows").alias("_n"), F.sum("_w").alias("_sw"))
    rated = counts.crossJoin(F.broadcast(total)).withColumn(
        "rate", F.when(F.col("_w") > 0, F.lit(float(budget)) * F.col("_n") * F.col("_w")
                       / (F.col("_sw") * F.col("rows"))).otherwise(0.0))
    rated = rated.withColumn(
        "parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    first = F.exp(-mean)
    walk = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1)
                                         + acc["p"] * mean / k)).alias("cdf")))
    return rated.select("_mix_key", "rows", "rate", "parts", walk["cdf"].alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *,
                key: str = "source", id_col: str = "doc_id", budget: float = 1.0,
                seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in global random
    order, plus ``copy`` (1, 2, ...) and ``mix_key`` (the order of the mix).

    * Rows are dealt out by ``mix_key`` and sorted by it inside each partition,
      so the files of the result are a random permutation of all copies.
    * Rows that share an id get the same count (each row its own copies); for a
      null id the whole row's hash is drawn with, so equal rows share theirs.
      Null and empty texts are copied like any other.
    * An empty table gives an empty mix. Input columns called ``copy`` or
      ``mix_key`` are replaced.
    * The rates have one row per source and are written first, so that their
      size is known when the join is planned: Spark broadcasts them under its
      size threshold (texts are then not shuffled by source), and otherwise
      splits the shuffled hot source.
    """
    docs = without(docs, ["copy", "mix_key"])
    rates = written(repetition_rates(docs, weights, key=key, budget=budget).select(
        "_mix_key", F.col("parts").alias("_mix_parts"), F.col("cdf").alias("_mix_cdf")),
        "mix-rates")
    # a null id says nothing: the whole row stands for it, so that such rows are
    # drawn and placed apart
    whole = F.concat(F.lit("null:"), F.xxhash64(packed(docs)).cast("string"))
    base = docs.select(packed(docs).alias("row"), F.col(f"`{key}`").alias("_mix_source"),
                       F.coalesce(F.col(f"`{id_col}`").cast("string"), whole).alias("_mix_id"))
    ident = F.col("_mix_id")
    placed = base.join(rates, F.col("_mix_source").eqNullSafe(F.col("_mix_key")))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0),
        lambda acc, part: acc + F.size(F.filter(
            F.transform(F.col("_mix_cdf"),
                        lambda c: F.struct(c.alias("c"), F.col("_mix_u")[part - 1].alias("u"))),
            lambda s: s["c"] <= s["u"])))
    draws = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")),
                        lambda part: uniform(seed, ident, part.cast("string")))
    counted = placed.withColumn("_mix_u", draws).withColumn("_mix_n", copies)
    copied = counted.select(
        "row", "_mix_id",
        F.posexplode(F.array_repeat(F.lit(0), F.col("_mix_n"))).alias("_mix_pos", "_mix_zero"))
    mixed = copied.withColumn("copy", F.col("_mix_pos") + 1).withColumn(
        "mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident,
                                     F.col("copy").cast("string"))))
    return (mixed.select(*unpacked("row", docs.columns), "copy", "mix_key")
            .repartition("mix_key").sortWithinPartitions("mix_key"))


#: The same rows by SQL: the inversion as a recursion over the counts.
MIX_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS rows_ FROM {{docs}} GROUP BY source),
tot AS (SELECT CAST(sum(rows_) AS DOUBLE) AS all_rows, CAST(count(*) AS DOUBLE) AS k FROM n),
rate AS (SELECT source, 1.0::DOUBLE * all_rows * 1.0::DOUBLE / (k * rows_) AS rate FROM n, tot),
part AS (SELECT source, greatest(CAST(ceil(rate / {PART_MEAN}::DOUBLE) AS INTEGER), 1) AS parts,
                rate FROM rate),
walk AS (
  SELECT source, parts, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS p,
         exp(-(rate / parts)) AS cdf FROM part
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1)
  FROM walk WHERE k < ceil(mean + 12 * sqrt(mean) + 20)),
draw AS (
  SELECT d.doc_id, d.source, u.part,
         CAST(('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || u.part), 1, 13)) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS u
  FROM {{docs}} d JOIN part p ON d.source IS NOT DISTINCT FROM p.source,
       LATERAL (SELECT unnest(range(1, p.parts + 1)) AS part) u),
cnt AS (
  SELECT d.doc_id, count(*) AS n FROM draw d JOIN walk w
    ON d.source IS NOT DISTINCT FROM w.source AND w.cdf <= d.u GROUP BY d.doc_id)
SELECT d.*, CAST(c.copy AS INTEGER) AS copy,
       md5('{SEED}:order:' || d.doc_id || ':' || c.copy) AS mix_key
FROM {{docs}} d JOIN cnt ON d.doc_id = cnt.doc_id,
     LATERAL (SELECT unnest(range(1, cnt.n + 1)) AS copy) c
"""

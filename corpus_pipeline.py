"""A training corpus from ``documents``: the stages in ``STAGES``, one after the
other, each written as Parquet and read again as the next one's input.

Every stage works on all rows that the one before it kept and returns the
columns of ``documents`` (the last adds ``copy`` and ``mix_key``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import packed, table, unpacked, written
from tunedata.llm.decontaminate import find_contamination
from tunedata.llm.langid import predict_languages, train_langid
from tunedata.llm.line_dedup import dedup_lines
from tunedata.llm.mixing import mix_sources
from tunedata.llm.near_dup import first_of_each_class


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go: null texts, texts without
    a letter and those under the fitted confidence."""
    model = train_langid(docs, F.lit(True))
    # a prefix that makes names unlike all others
    prefix = "_langid_" + "_" * max(len(c) for c in docs.columns)
    named = predict_languages(docs, model, keep=docs.columns, prefix=prefix)
    return named.filter(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go where they occur again; a document of which nothing
    is left goes with them. ``n_chars`` follows the new text."""
    done = dedup_lines(docs)
    rest = done.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.select(*[
        F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(c))
        .cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest
    id."""
    return first_of_each_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    keyed = docs.select(packed(docs).alias("row"), "doc_id", "text", F.xxhash64("text").alias("hash"))
    hits = find_contamination(keyed, table(spark, sf_dir, "benchmark"), keep=["doc_id", "hash"])
    # written first: its size then decides how it is joined
    hits = written(hits.select(F.col("doc_id").alias("leak_id"), F.col("hash").alias("leak_hash")).distinct(),
                   "pipeline-leaks")
    return keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.col("hash") == F.col("leak_hash")),
                      "left_anti").select(*unpacked("row", docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source with the same expected number of rows, shuffled."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Language ID, consistent sampling and edit matching have no SQL form; the
#: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

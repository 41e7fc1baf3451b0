"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .decontaminate import find_contamination
from .fim import FIM_SQL, fim_restore, fim_transform
from .hard_negatives import HARD_NEGATIVE_SQL, hard_negatives
from .html_region import extract_text, train_region
from .langid import predict_languages, train_langid
from .licenses import license_sql, scan_licenses
from .line_dedup import dedup_lines, line_dedup_sql
from .mixing import MIX_SQL, mix_sources
from .near_dup import near_duplicates
from .ngram_bloom import lm_scores
from .quality import quality_rules, quality_sql
from .shingle_join import shingle_links
from .toxicity import score_toxicity, train_toxicity


def op1_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from four in five of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train_langid(docs, ~held_out)
    return predict_languages(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from two in three of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document; six in seven are learned from."""
    return lm_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with later occurrences of three-line windows removed."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed")


def op5_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains, with up
    to one edit in twenty characters."""
    return find_contamination(table(spark, sf_dir, "documents"),
                              table(spark, sf_dir, "benchmark"))


def op6_icws_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train_region(pages))


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, entire and line by line."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that each source gets the same weight."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; a seventh of the labels is
    changed first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_sparse_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document as cut for fill-in-middle and as rebuilt."""
    cut = fim_transform(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim_restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of linked documents that every document belongs to."""
    return shingle_links(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_langid": op1_subword_langid,
    "op2_divergence_rules": op2_divergence_rules,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_line_windows": op4_line_windows,
    "op5_edit_matching": op5_edit_matching,
    "op6_icws_near_duplicates": op6_icws_near_duplicates,
    "op7_best_region": op7_best_region,
    "op8_license_digests": op8_license_digests,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_boosted_toxicity": op10_boosted_toxicity,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_sparse_fim": op12_sparse_fim,
    "op13_token_groups": op13_token_groups,
}

ORACLE: dict[str, str] = {
    "op2_divergence_rules": quality_sql(),
    "op4_line_windows": line_dedup_sql(),
    "op8_license_digests": license_sql(),
    "op9_poisson_mix": MIX_SQL.format(docs="documents"),
    "op11_angular_negatives": HARD_NEGATIVE_SQL,
    "op12_sparse_fim": FIM_SQL,
}

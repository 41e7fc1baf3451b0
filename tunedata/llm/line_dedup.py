"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed together; a window that
occurs more than once in the corpus stays where it occurs first (smallest
document id, then earliest line), and the lines that later occurrences cover
are removed, overlapping ones merged. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, packed, unpacked, without, written

WINDOW = 3


def _windows(text: Column) -> Column:
    """array<struct<p0, p2, h1, h2>>: the windows over the lines with a word;
    p0 and p2 are the line numbers of their first and last line, h1 and h2 128
    bits of hash over the three trimmed lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"),
                        lambda line, i: F.struct(F.btrim(line, F.lit(SPACES)).alias("s"),
                                                 i.alias("p")))

    def over(full: Column) -> Column:
        last = F.size(full) - WINDOW
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda j: F.struct(
                full[j]["p"].alias("p0"), full[j + 2]["p"].alias("p2"),
                F.xxhash64(full[j]["s"], full[j + 1]["s"], full[j + 2]["s"]).alias("h1"),
                F.xxhash64(full[j + 2]["s"], F.lit("2"), full[j + 1]["s"],
                           full[j]["s"]).alias("h2"))))

    return let(F.filter(lines, lambda line: line["s"] != F.lit("")), over)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``_id``, ``_th`` (hash of the text) and ``_spans``: the line spans that
    later occurrences of repeated windows cover in that document."""
    occ = written(docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_th"),
        F.explode(_windows(F.col(f"`{text_col}`"))).alias("w"))
        .select("_id", "_th", "w.*"), "line-windows")
    place = F.struct("_id", "_th", "p0")
    # partial aggregation first: a window that a third of all rows share is one
    # row per task before the shuffle
    groups = written(
        occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "line-repeats")
    # both sides are plain files, so that a skewed window can be split
    later = occ.join(groups, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_th").agg(F.collect_set(F.struct("p0", "p2")).alias("_spans"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from the text column, plus
    ``n_lines`` (lines before) and ``n_removed``.

    * Lines are compared without white space at their ends. Lines without a
      word are no part of windows; those inside a removed span go with it.
      Fewer than three lines with a word: nothing is removed.
    * The first occurrence is that with the smallest id (null first), then
      text hash, then line. Rows that share id and text count as one document
      and get the same result. Inside one text later occurrences go too.
    * A null text stays null with 0 lines, an empty text has one line. A text
      whose lines all go becomes ''. An empty table stays empty. Input columns
      called ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = without(docs, ["n_lines", "n_removed"])
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col)
    text = F.col("text")
    keyed = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("hash"))
    both = keyed.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_th")), "left")
    gone = F.array_distinct(F.flatten(F.transform(
        "_spans", lambda s: F.sequence(s["p0"], s["p2"]))))

    def kept(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
                           lambda i: lines[i])

    lines = F.split(text, "\n")
    new = F.when(F.col("_spans").isNull(), text).otherwise(
        F.array_join(let(lines, kept), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("_spans").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return both.select(
        *[new.alias(c) if c == text_col else x for c, x in zip(docs.columns, unpacked("row", docs.columns))],
        n_lines.alias("n_lines"), removed.alias("n_removed"))


def line_dedup_sql(docs: str = "documents") -> str:
    """``doc_id``, ``text``, ``n_lines``, ``n_removed`` as DuckDB SQL."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS p FROM {docs}),
f AS (SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, p AS p0, lead(p, 2) OVER o AS p2,
             s || chr(10) || lead(s, 1) OVER o || chr(10) || lead(s, 2) OVER o AS k
      FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p0, p2, row_number() OVER (PARTITION BY k ORDER BY doc_id, p0) AS nth
      FROM w WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(p0, p2 + 1)) AS p FROM r WHERE nth > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
                string_agg(CASE WHEN g.p IS NULL THEN l.line END, chr(10) ORDER BY l.p) AS text
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM kept
"""

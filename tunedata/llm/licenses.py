"""Licence scan by canonical digest lookup.

A text is made canonical (case, copyright lines, equivalent spellings,
punctuation, white space), digested with SHA-256 and hash-joined to the digests
of known licence texts. Digested are the entire document, and each of its lines
as an entire text of its own, which finds notices inside other documents.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Canonical spellings of words that licence texts use in two
# forms (after lower-casing).
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("programme", "program"), ("whilst", "while"),
    ("https:", "http:"), ("&", " and "),
]
#: A line that only says who holds the copyright, or reserves all rights.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*((copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*"
                  r"|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$")
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# Licence notices and short licence texts, in their published
# wording.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
"""
_BSD_REST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_FULL_NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
_NOTICE_FORMS = [
    "Released under the {}.", "Released under {}.", "Licensed under the {}.",
    "Licensed under {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "Distributed under the {}.", "Distributed under {}.",
    "This project is licensed under the {}.", "This software is released under the {}.",
]


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of everything looked up: full texts with and without
    their title, one-line notices and SPDX tags."""
    full = [
        ("MIT", "MIT License", _MIT),
        ("ISC", "ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and "
         f"this permission notice appear in all copies.\n\n{_ISC_REST}"),
        ("0BSD", "BSD Zero Clause License", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
        ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_REST),
        ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_NAME + _BSD_REST),
    ]
    out = [(i, t) for i, _, t in full] + [(i, f"{name}\n\n{t}") for i, name, t in full]
    out += [(i, form.format(name)) for i, name in _FULL_NAMES for form in _NOTICE_FORMS]
    return out + [(i, f"SPDX-License-Identifier: {i}") for i, _ in _FULL_NAMES]


def canonical_lines(text: Column) -> Column:
    """The canonical non-empty lines of a text (no lines for null)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, NOT_WORD, " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda line: F.btrim(line)),
                    lambda line: line != F.lit(""))


def entire_digest(lines: Column) -> Column:
    """Digest of an entire canonical text; line breaks count as blanks."""
    return F.sha2(F.array_join(lines, " "), 256)


def license_table(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest``, ``license_id`` of the known texts, made canonical by the very
    expressions used on documents. Texts that share a digest keep the smallest
    id."""
    rows = spark.createDataFrame(texts or known_texts(), "license_id string, text string")
    return (rows.select("license_id", canonical_lines(F.col("text")).alias("lines"))
            .filter(F.size("lines") > 0)
            .groupBy(entire_digest(F.col("lines")).alias("digest"))
            .agg(F.min("license_id").alias("license_id")))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, *,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``text_digest`` (of the entire canonical
    text), ``license_id`` (the known licence that the entire text is, or null),
    ``line_licenses`` (sorted distinct licences of single lines joined by ',';
    '' if none) and ``n_license_lines``.

    * Null, empty and punctuation-only texts have digest null and no licence.
    * Copyright lines do not count for any digest, repeated rows each give
      their own row, ties between licences with one digest go to the smaller
      id, other input columns (also clashing ones) are not read.
    * A null id is kept as null. An empty table gives an empty result.

    Each document gives one row per line and one for the whole; they meet the
    known digests in a hash join whose small side Spark broadcasts under its
    own size threshold, and are summed per document in the task that made them
    before the one shuffle.
    """
    known = license_table(docs.sparkSession) if known is None else known
    # written first, so that its size is known when the join is planned
    known = written(known, "license-digests")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                       canonical_lines(F.col(text_col)).alias("_lines"))
    whole = F.array(F.when(F.size("_lines") > 0, entire_digest(F.col("_lines"))))
    units = base.select("_id", "_th", F.posexplode(F.concat(
        whole, F.transform("_lines", lambda line: F.sha2(line, 256)))).alias("_pos", "digest"))
    found = units.join(known, "digest", "left")
    entire = F.col("_pos") == 0
    per_doc = found.groupBy("_id", "_th").agg(
        F.count(F.when(entire, 1)).cast("int").alias("_rows"),
        F.max(F.when(entire, F.col("digest"))).alias("text_digest"),
        F.max(F.when(entire, F.col("license_id"))).alias("license_id"),
        F.collect_set(F.when(~entire & F.col("license_id").isNotNull(),
                             F.struct("_pos", "license_id"))).alias("_hits"))
    return per_doc.select(
        F.col("_id").alias(id_col), "text_digest", "license_id",
        F.array_join(F.array_sort(F.array_distinct(
            F.transform("_hits", lambda h: h["license_id"]))), ",").alias("line_licenses"),
        F.size("_hits").cast("long").alias("n_license_lines"),
        F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_r")).drop("_r")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    for old, new in SPELLINGS:
        t = f"replace({t}, {_sql_text(old)}, {_sql_text(new)})"
    t = f"regexp_replace({t}, {_sql_text(NOT_WORD)}, ' ', 'g')"
    return (f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), "
            f"lambda x: x <> '')")


def license_sql(docs: str = "documents") -> str:
    """The same rows as DuckDB SQL."""
    values = ",\n".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in known_texts())
    return f"""
WITH raw(license_id, text) AS (VALUES {values}),
known AS (SELECT sha256(array_to_string({_sql_lines('text')}, ' ')) AS digest,
                 min(license_id) AS license_id FROM raw GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM {docs}),
w AS (SELECT doc_id, CASE WHEN len(lines) > 0
             THEN sha256(array_to_string(lines, ' ')) END AS text_digest FROM d),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
h AS (SELECT l.doc_id, count(*) AS n,
             array_to_string(list_sort(list_distinct(list(k.license_id))), ',') AS ids
      FROM l JOIN known k ON sha256(l.line) = k.digest GROUP BY 1)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(h.ids, '') AS line_licenses,
       coalesce(h.n, 0) AS n_license_lines
FROM w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN h ON w.doc_id = h.doc_id
"""

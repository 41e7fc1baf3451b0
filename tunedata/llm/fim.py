"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into prefix, middle and suffix at two hash-drawn places and
written in the order of its form. Cuts are drawn in code points while texts are
UTF-8 bytes: an index of the multibyte characters alone (where they stand and
how many bytes they have beyond one) turns one into the other. Between them
both counts run alike, so an ASCII text needs no index and no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.session import ship_package

from .common import fresh, without
from .workers import BATCH_CHARS

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Percent of the texts that are transformed, and of those in spm order.
FIM_PERCENT, SPM_PERCENT = 90, 20
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass
class ExceptionIndex:
    """The multibyte characters of UTF-8 bytes: ``at_byte`` and ``at_char``
    (where each begins, in bytes and in code points) and ``excess`` (bytes
    beyond one a character of the first k of them, k from 0)."""

    at_byte: np.ndarray
    at_char: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(more)])
        return cls(at, at - excess[:-1], excess)

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Where the characters numbered ``chars`` begin, in bytes."""
        return chars + self.excess[np.searchsorted(self.at_char, chars, "left")]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """How many characters begin before the bytes ``cuts`` (which must not
        be inside a character)."""
        return cuts - self.excess[np.searchsorted(self.at_byte, cuts, "left")]


def _piece(data: np.ndarray, ends: np.ndarray, draws: np.ndarray, fim: int, spm: int) -> list[list]:
    """The new columns of texts that lie one after the other in ``data``."""
    index = ExceptionIndex.of(data)
    bounds = index.to_chars(ends)
    first, n = bounds[:-1], np.diff(bounds)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    at = index.to_bytes(first[:, None] + cuts)
    raw = data.tobytes()
    form, output = [], []
    for i, (a, b) in enumerate(at.tolist()):
        start, end = int(ends[i]), int(ends[i + 1])
        text = raw[start:end]
        if not text or draws[i, 2] % 100 >= fim or any(m in text for m in _MARKS):
            form.append("plain")
            output.append(text)
            continue
        p, s, m = _MARKS
        prefix, middle, suffix = raw[start:a], raw[a:b], raw[b:end]
        if draws[i, 3] % 100 < spm:
            form.append("spm")
            output.append(b"".join([s, suffix, p, prefix, m, middle]))
        else:
            form.append("psm")
            output.append(b"".join([p, prefix, s, suffix, m, middle]))
    plain = np.array([f == "plain" for f in form], bool)
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()),
            pa.array(cuts[:, 0], pa.int64(), mask=plain),
            pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
            pa.array(output, pa.binary()).view(pa.string())]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows in them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def fim_transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  seed: int = 1, keep: list[str] | None = None,
                  fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``keep`` columns (the id by default) and, for each row, ``n`` (code
    points of the text), ``form``, ``prefix_chars``, ``middle_chars`` (null if
    plain) and ``output``.

    Four numbers come from the sha256 of ``seed:id``: two cuts (modulo n + 1),
    whether the text is transformed, and whether in the order suffix, prefix,
    middle (``spm``) or prefix, suffix, middle (``psm``).

    * Null and empty texts, and texts that contain one of the three marks, stay
      ``plain``: their output is the text (empty for null), so ``fim_restore``
      is exact. Very long texts are cut whole, a few megabytes of texts (or one
      text) at a time.
    * A null id is hashed as an empty string. Rows with one id get the same
      numbers, repeated rows the same output; none is dropped.
    * An empty table gives no rows. ``keep`` columns called like a new column
      give way to it, in any case; others are passed on untouched.
    """
    ship_package(docs.sparkSession)
    kept = without(docs.select(*[F.col(f"`{c}`") for c in (keep or [id_col])]), ADDED).columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    own = fresh(kept, "draws", "text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], draws.alias(own[0]),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(own[1]))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema,
                           T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            data, bounds = _texts(columns[-1])
            numbers = columns[-2].flatten().to_numpy().reshape(-1, 4)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BATCH_CHARS, "right")) - 1)
                added = _piece(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i],
                               numbers[i:j], fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in columns[:-2]] + added, names=names)
                i = j

    return source.mapInArrow(run, schema)


def fim_restore(output: Column, form: Column) -> Column:
    """The text that ``fim_transform`` made ``output`` of. Null output or form
    gives null."""
    part = F.split(output, "<[PSM]>")
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])))


FIM_SQL = """
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS text,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
d AS (
    SELECT doc_id, text, length(text) AS n,
           CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
           CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4
    FROM h),
c AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a,
           greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
o AS (
    SELECT *, CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || text[1:a] || '<S>' || text[b + 1:] || '<M>' || text[a + 1:b]
              ELSE '<S>' || text[b + 1:] || '<P>' || text[1:a] || '<M>' || text[a + 1:b] END AS output
    FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""

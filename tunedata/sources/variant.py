"""Ingest of JSON lines whose keys drift, by the VARIANT type.

A line is parsed once. Each wanted field is looked for under several names, and
a key that is missing is told apart from one that is null and from one that
holds something else than a string; a line that cannot be parsed, or is no
object, is kept as it is with its status.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field -> the keys it is written under, first the one that counts if a line
#: has several.
FIELDS: dict[str, tuple[str, ...]] = {
    "problem": ("problem", "input"), "answer": ("answer", "output"), "type": ("type",)}
OK, CORRUPT, NOT_OBJECT = "ok", "corrupt", "not_object"
MISSING, NULL, STRING, OTHER = "missing", "null", "string", "other"


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (the line), ``doc`` (VARIANT, null if it cannot be parsed) and
    ``status`` of every line that is not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    doc = lines.select("value", F.try_parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    return doc.withColumn("status", F.when(F.col("doc").isNull(), CORRUPT)
                          .when(~kind.startswith("OBJECT"), NOT_OBJECT).otherwise(OK))


def _path(key: str) -> str:
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return f'$["{quoted}"]'


def _found(doc: Column, keys: Sequence[str]) -> Column:
    """The value (VARIANT) of the first of ``keys`` that the object has."""
    return F.coalesce(*[F.try_variant_get(doc, _path(k), "variant") for k in keys])


def field_state(doc: Column, keys: Sequence[str]) -> Column:
    found = _found(doc, keys)
    return (F.when(found.isNull(), MISSING).when(F.is_variant_null(found), NULL)
            .when(F.schema_of_variant(found) == "STRING", STRING).otherwise(OTHER))


def field_text(doc: Column, keys: Sequence[str]) -> Column:
    """The string, the JSON text of any other value, null if null or missing."""
    found = _found(doc, keys)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")).when(
        ~F.is_variant_null(found), F.to_json(found))


def ingest(lines: DataFrame, fields: Mapping[str, Sequence[str]] = FIELDS,
           defaults: Mapping[str, str] | None = None) -> DataFrame:
    """``status``, ``value`` (the line, where it is not an object) and for each
    field its text and ``<field>_state``.

    ``defaults`` fill a field whose key is missing; a key that is there and
    null stays null."""
    doc, defaults = F.col("doc"), dict(defaults or {})
    out = [F.col("status"), F.when(F.col("status") != OK, F.col("value")).alias("value")]
    for name, keys in fields.items():
        state = F.when(F.col("status") == OK, field_state(doc, keys))
        text = F.when(F.col("status") == OK, field_text(doc, keys))
        if name in defaults:
            text = F.when(state == MISSING, F.lit(defaults[name])).otherwise(text)
        out += [text.alias(name), state.alias(f"{name}_state")]
    return lines.select(*out)


def complete(rows: DataFrame, names: Sequence[str] = ("problem", "answer")) -> DataFrame:
    """P8 on ingested rows: the objects that have all of ``names``, null or not."""
    keep = F.col("status") == OK
    for n in names:
        keep = keep & (F.col(f"{n}_state") != MISSING)
    return rows.where(keep)


def drift(lines: DataFrame) -> DataFrame:
    """``key``, ``kind``, ``lines``: how many objects hold a key with a value of
    that kind. One row a key of a line at most, counted before the shuffle."""
    spark = lines.sparkSession
    rows = lines.where(F.col("status") == OK).select(F.col("doc").alias("doc"))
    pairs = rows.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    kind = F.when(F.is_variant_null("value"), F.lit("NULL")).otherwise(
        F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0))
    return (pairs.select(F.col("key"), kind.alias("kind")).groupBy("key", "kind")
            .agg(F.count(F.lit(1)).alias("lines")))


def merged_schema(lines: DataFrame) -> DataFrame:
    """One row: the schema that all objects fit, as Spark writes it."""
    return lines.where(F.col("status") == OK).agg(F.schema_of_variant_agg("doc").alias("schema"))

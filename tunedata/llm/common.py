"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.session import scratch_path

#: The white space that separates words: blank, tab, line feed, vertical tab,
#: form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from the files, not from the work that made them, also after a lost
    executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys are told by so many slots in ``among``: a broadcast of bounded size.
SLOTS = 1 << 20


def among(df: DataFrame, key: str, wanted: DataFrame, name: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of ``wanted`` (column
    ``name``, by default ``key``), and few others while those are fewer than
    SLOTS. Nothing is shuffled: most rows go before a join or a comparison."""
    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = written(wanted.select(slot(name or key).alias("slot")).distinct(), "slots")
    return (df.withColumn("slot", slot(key)).join(F.broadcast(slots), "slot", "left_semi")
            .drop("slot"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    A column used inside a lambda is otherwise put in place of its name by the
    optimizer and worked out again for each element.
    """
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS),
                    lambda w: w != F.lit(""))


def same_doc(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of key columns of two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that are called like a new column (in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct. Work goes on beside it under names
    that none of them can clash with; ``unpacked`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, names: list[str]) -> list[Column]:
    """The columns ``names`` of a struct made by ``packed``."""
    return [F.col(row).getField(c).alias(c) for c in names]


def fresh(names: list[str], *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that none of ``names`` equals in any case:
    the wanted one, with underscores added until it is free."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Left joins with a table of unique keys, of which some are very common.

The keys that many rows will ask for are known from a count in the table, so
they are looked up by broadcast (their number is bounded by the share that
makes a key common). Rows that found theirs take part in the shuffle join of
the rest with a number that only spreads them out: no hot key is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this share of all rows is looked up by broadcast: at most
#: 1 / HEAD_SHARE keys, of strings of at most HEAD_TOKEN_BYTES each.
HEAD_SHARE = 2e-5
HEAD_TOKEN_BYTES = 256
SPREAD = 65_536


def hot_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str,
               values: Sequence[str]) -> DataFrame:
    """``rows`` with the ``values`` of ``table`` (null where it has no such
    key). ``on`` are strings or numbers that are never null, unique in ``table``,
    which should be written as it is read several times; ``weight`` says how common
    a key is."""
    on, values = list(on), list(values)
    total = F.broadcast(table.agg(F.sum(weight).alias("_all")))
    common = F.col(weight) >= HEAD_SHARE * F.col("_all")
    for c in [c for c in on if dict(table.dtypes)[c] == "string"]:
        common = common & (F.octet_length(c) <= HEAD_TOKEN_BYTES)
    marked = table.crossJoin(total).withColumn("_head", common)       # one row
    head = marked.where("_head").select(*on, F.lit(True).alias("_hit"),
                                        *[F.col(v).alias(f"_h_{v}") for v in values])
    tail = marked.where("NOT _head").select(*[F.col(c).alias(f"_t_{c}") for c in on], F.lit(0).alias("_t_spread"),
                                            *[F.col(v).alias(f"_t_{v}") for v in values])
    spread = (F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)) + 1).cast("int")
    found = rows.join(F.broadcast(head), on, "left").withColumn(
        "_spread", F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(spread))
    cond = found[on[-1]] == tail[f"_t_{on[-1]}"]           # sorted by it first: few rows share it
    for c in on[:-1]:
        cond = cond & (found[c] == tail[f"_t_{c}"])
    cond = cond & (F.col("_spread") == F.col("_t_spread"))
    return found.join(tail, cond, "left").select(
        *[found[c] for c in rows.columns], *[F.coalesce(f"_h_{v}", f"_t_{v}").alias(v) for v in values])

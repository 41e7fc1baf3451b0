"""Ordered-neighbour access inside groups that may be arbitrarily large.

``lead(c) over (partition by g order by o)`` sends a whole group to one task;
a single group holding a large share of the rows would then be one straggler.
``lead_in_group`` gives the same values with windows bounded by ``width``
rows: the (unique, integral) order column is cut into ranges of ``width``
values, ``lead`` runs inside each (group, range), and the last row of a range
takes the first row of the group's next non-empty range from a per-range
table (one row per range, so 1 / width of the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_WIDTH = 4096


def lead_in_group(df: DataFrame, group: str, order: str, cols: Sequence[str],
                  prefix: str = "next_", width: int = RANGE_WIDTH) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` in the next row of the same
    ``group`` by ``order`` (NULL for the last row). ``order`` must be an
    integer column unique within ``group``."""
    cols = list(cols)
    x = df.withColumn("_lg_r", F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(group, "_lg_r").orderBy(order)
    for c in cols:
        x = x.withColumn(f"_lg_{c}", F.lead(c).over(inner))
    x = (x.withColumn("_lg_last", F.lead(order).over(inner).isNull())
         .withColumn("_lg_head", F.lag(order).over(inner).isNull()))
    # first row of every range, straight from the same window (no aggregate)
    firsts = x.where(F.col("_lg_head")).select(group, "_lg_r",
                                                F.struct(*cols).alias("_lg_first"))
    nxt = firsts.select(group, "_lg_r", F.lead("_lg_first").over(
        Window.partitionBy(group).orderBy("_lg_r")).alias("_lg_nf"))
    x = x.join(nxt, [group, "_lg_r"], "left")
    for c in cols:
        x = x.withColumn(prefix + c, F.when(F.col("_lg_last"), F.col("_lg_nf")[c])
                         .otherwise(F.col(f"_lg_{c}")))
    return x.drop("_lg_r", "_lg_last", "_lg_head", "_lg_nf", *[f"_lg_{c}" for c in cols])

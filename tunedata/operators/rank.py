"""Global ranks without a single-partition window.

``row_number().over(Window.orderBy(k))`` moves every row into one task. Here
the order key is cut into buckets that are monotone in the order:

1. ``bucket`` per row (a hex prefix of an md5 key, or a quantile bucket of a
   numeric key);
2. ``groupBy(by, bucket).count()`` with map-side combine -> running sum of the
   counts over the (bounded) bucket table -> ``offset`` per bucket;
3. ``rank = offset + row_number() over (partitionBy(by, bucket) orderBy key)``.

The offsets are joined on the columns that the row-number window is
partitioned by, so both share one shuffle of the rows (Spark broadcasts the
offsets instead only when they are small). The window runs on ``#buckets``
parallel partitions. The result is a pure function of the data (independent of
partitioning) and equals
``row_number() over (partition by <by> order by <key> nulls last, <tiebreak>)``.

``range_rank`` does the same for any order, with the range partitions of Spark
as buckets, so their number follows the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions.text import col_, seeded_key
from tunedata.session import materialize

HEX_CHARS = 4            # 65,536 buckets; offset table <= 65,536 rows per group
NULL_BUCKET = "~"        # after every hex prefix: rows with a null key come last
KEY_BUCKETS = 256        # quantile buckets for numeric keys


def ranked(df: DataFrame, bucket: Column, order: Sequence[Column | str],
           name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Add 1-based ``name`` = position of the row in ``order`` within ``by``.

    ``bucket`` must be monotone in ``order`` and have a small, bounded number
    of values, none of them null; null is a group of its own in ``by``.
    """
    by = list(by)
    # a struct is never null itself, and null fields in it are equal
    group = F.struct(*by).alias("_rk_g") if by else F.lit(0).alias("_rk_g")
    tmp = df.select("*", group, bucket.alias("_rk_b"))
    keys = ["_rk_g", "_rk_b"] if by else ["_rk_b"]
    counts = tmp.groupBy("_rk_g", "_rk_b").agg(F.count(F.lit(1)).alias("_rk_n"))
    before = (Window.partitionBy(*keys[:-1]).orderBy("_rk_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"))
    within = Window.partitionBy(*keys).orderBy(*[col_(c) for c in order])
    return (tmp.join(offsets, keys)
            .withColumn(name, (F.col("_rk_off") + F.row_number().over(within)).cast("long"))
            .drop("_rk_g", "_rk_b", "_rk_off"))


def hash_rank(df: DataFrame, seed: int | str, key: Column | str, name: str = "rank",
              by: Sequence[str] = (), hex_chars: int = HEX_CHARS) -> DataFrame:
    """Seeded pseudo-random rank: order by ``md5('<seed>:<key>')``, then ``key``.

    Same numbers as DuckDB
    ``row_number() over (order by md5(seed || ':' || key), key)``; rows with a
    null key are kept and come last.
    """
    k = seeded_key(seed, key)
    bucket = F.coalesce(F.substring(k, 1, hex_chars), F.lit(NULL_BUCKET))
    return ranked(df, bucket, [k, col_(key)], name, by)


def range_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank by any order (``order`` must tell all rows apart, or equal rows be
    interchangeable). Rows are range-partitioned and written once, so that the
    buckets stay the same in every later read; pass key-only rows."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_rr_b", F.spark_partition_id()),
                        "range-rank")
    return ranked(dealt, F.col("_rr_b"), order, name).drop("_rr_b")


def _search_tree(c: Column, bounds: list, lo: int, hi: int) -> Column:
    # number of bounds[lo:hi] strictly below c, plus lo (binary search)
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(c > F.lit(bounds[mid]), _search_tree(c, bounds, mid + 1, hi)).otherwise(
        _search_tree(c, bounds, lo, mid))


def key_rank(df: DataFrame, key: str, name: str = "rank", by: Sequence[str] = (),
             buckets: int = KEY_BUCKETS) -> DataFrame:
    """Rank by a unique numeric ``key`` (e.g. a line number or record id).

    Bucket bounds are ``buckets - 1`` approximate quantiles of the key (one
    small aggregate, read once so both uses see the same bounds); the bucket
    of a row is found with a depth-log2(buckets) comparison tree that stays in
    generated code. Skewed key ranges still give even buckets; null keys come
    last.
    """
    qs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(key), qs, 10000).alias("q")).first()
    bounds = sorted(set(v for v in (row["q"] or []) if v is not None))
    bucket = F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(
        _search_tree(F.col(key), bounds, 0, len(bounds)))
    return ranked(df, bucket, [key], name, by)

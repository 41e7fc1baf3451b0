"""Class split, ratio plans, exact sampling, shuffling and train/validation
splits.

Randomness is seeded and engine-independent: a row's order key is
``md5('<seed>:<row key>')`` (ties by the key), and every "take n" is
``global rank <= n`` (``operators.rank``), never ``df.sample`` (approximate
sizes) and never a single-partition window. Ranks inside a class are
partitioned by ``(class, md5 bucket)``, so a class holding most rows is still
spread over all buckets.

Upstream behaviour kept on purpose: the plan truncates (``int()``) in double
arithmetic, so one row can be lost (8765 / 29896 at 40/60 -> 8764 + 13147).
Upstream defect fixed: a ratio part of 0 divided by zero; here it is a
``ValueError`` before any job runs. Upstream *oversample never oversamples*:
the plan takes ``min`` so both targets fit their class; ``mode='oversample'``
here takes ``max`` so the minority class really grows (draws with
replacement), and ``cap='reference'`` keeps the upstream ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.functions.text import col_, seeded_key
from tunedata.operators.rank import hash_rank
from tunedata.session import default_parallelism

ORIGINAL_FLAG = "is_original"
#: draws that share one copy of a drawn row
DRAWS_PER_COPY = 1000


# --- R1 / R2 -----------------------------------------------------------------
def is_original(type_: Column | str = "type") -> Column:
    """Original vs. everything else; a null or missing type counts as other."""
    return F.coalesce(col_(type_).eqNullSafe(T.ORIGINAL), F.lit(False))


def class_split(df: DataFrame, type_: str = "type") -> DataFrame:
    return df.withColumn(ORIGINAL_FLAG, is_original(type_))


def filter_original(df: DataFrame, type_: str = "type") -> DataFrame:
    return df.where(F.col(type_) == T.ORIGINAL)


# --- R3 ----------------------------------------------------------------------
def _check_ratio(ratio) -> tuple[float, float]:
    r0, r1 = ratio
    if r0 <= 0 or r1 <= 0:
        raise ValueError(f"ratio parts must be > 0, got {ratio!r}")
    return r0 / 100, r1 / 100          # Python doubles, as upstream


def sample_plan(df: DataFrame, ratio=(40, 60), mode: str = "downsample",
                cap: str = "ours", flag: str = ORIGINAL_FLAG) -> DataFrame:
    """One row: class sizes, total and per-class targets."""
    if mode not in ("downsample", "oversample"):
        raise ValueError(f"mode must be 'downsample' or 'oversample', got {mode!r}")
    if cap not in ("ours", "reference"):
        raise ValueError(f"cap must be 'ours' or 'reference', got {cap!r}")
    f0, f1 = _check_ratio(ratio)
    pick = F.greatest if (mode == "oversample" and cap != "reference") else F.least
    counts = df.agg(F.count_if(F.col(flag)).alias("n_original"),
                    F.count_if(~F.col(flag)).alias("n_other"))
    total = F.floor(pick(F.col("n_original") / F.lit(f0), F.col("n_other") / F.lit(f1)))
    return (counts.withColumn("total", total.cast("long"))
            .withColumn("original_target", F.floor(F.lit(f0) * F.col("total")).cast("long"))
            .withColumn("other_target", F.floor(F.lit(f1) * F.col("total")).cast("long")))


# --- R4 ----------------------------------------------------------------------
def downsample(df: DataFrame, target: int | Column, key: str, seed: int = 0,
               by: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """Exactly ``min(target, n)`` rows without replacement (per ``by`` group)."""
    r = hash_rank(df, seed, key, name=rank, by=by)
    t = F.lit(target) if isinstance(target, int) else target
    return r.where(F.col(rank) <= t)


# --- R5 ----------------------------------------------------------------------
def drawn_rank(seed: int, i: Column, n: Column | int) -> Column:
    """1-based rank drawn for draw ``i``: 1 + (48-bit md5 prefix) % n."""
    h = F.conv(F.substring(seeded_key(seed, i), 1, 12), 16, 10).cast("long")
    return F.lit(1) + h % (F.lit(n) if isinstance(n, int) else n)


def oversample(df: DataFrame, target: int, key: str, seed: int = 0,
               sample_id: str = "sample_id") -> DataFrame:
    """``target > n``: ``target`` i.i.d. draws with replacement; else
    ``target`` rows without replacement. ``sample_id`` numbers the draws."""
    n = df.count()
    if n == 0 or target <= 0:
        return hash_rank(df, seed, key, name=sample_id).where(F.lit(False))
    if target <= n:
        return downsample(df, target, key, seed, rank=sample_id)
    spark = df.sparkSession
    parts = max(1, min(target // 1_000_000 + 1, 100_000))
    copies = _copies(target, n)
    draws = (spark.range(0, target, 1, parts)
             .select((F.col("id") + 1).alias(sample_id),
                     drawn_rank(seed, F.col("id"), n).alias("_rank"))
             .withColumn("_copy", _copy_of(F.col(sample_id), copies)))
    ranked = hash_rank(df, seed, key, name="_rank").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return draws.join(ranked, ["_rank", "_copy"]).drop("_rank", "_copy")


def _copies(target: int, n: int) -> int:
    """Copies of each of ``n`` rows among which ``target`` draws are dealt, so
    that a tiny class with a huge target is not a few hot join keys; all copies
    together are about ``target / DRAWS_PER_COPY`` rows, or ``n``."""
    return max(1, -(-target // max(n, 1) // DRAWS_PER_COPY))


def _copy_of(sample_id: Column, copies: int) -> Column:
    return F.pmod(sample_id, F.lit(copies)).cast("int")


# --- R6 / R9 -----------------------------------------------------------------
def balance(df: DataFrame, key: str, ratio=(40, 60), mode: str = "downsample",
            seed: int = 0, type_: str = "type", cap: str = "ours",
            position: str = "position") -> DataFrame:
    """Re-balance Original vs. other to ``ratio``, then shuffle.

    Adds ``is_original``, ``sample_id`` (rank or draw number inside the class)
    and ``position`` (seeded permutation of the combined rows). Sampling and
    shuffling run on key-only rows; the full rows (``key`` must be unique)
    are joined back once at the end."""
    flagged = class_split(df, type_)
    keys = flagged.select(key, ORIGINAL_FLAG)
    copies = {True: 1, False: 1}
    plan = sample_plan(keys, ratio, mode, cap)
    if mode == "downsample" or cap == "reference":
        r = hash_rank(keys, seed, key, name="sample_id", by=(ORIGINAL_FLAG,))
        target = F.when(F.col(ORIGINAL_FLAG), F.col("original_target")).otherwise(
            F.col("other_target"))
        chosen = (r.crossJoin(F.broadcast(plan.select("original_target", "other_target")))
                  .where(F.col("sample_id") <= target)
                  .drop("original_target", "other_target"))
    else:
        p = plan.first()                       # two scalars per class
        parts = []
        for flag, tgt, n in ((True, p["original_target"], p["n_original"]),
                             (False, p["other_target"], p["n_other"])):
            cls = keys.where(F.col(ORIGINAL_FLAG) == flag)
            parts.append(oversample(cls, int(tgt), key, seed))
            copies[flag] = _copies(int(tgt), n)
        chosen = parts[0].unionByName(parts[1])
    skey = F.concat_ws(":", F.col(ORIGINAL_FLAG).cast("int").cast("string"),
                       F.col(key).cast("string"), F.col("sample_id").cast("string"))
    placed = shuffle_positions(chosen.withColumn("_skey", skey), "_skey", seed,
                               position).drop("_skey")
    # a row drawn very often is one hot key: its class is copied as for the draws
    copy = F.when(F.col(ORIGINAL_FLAG), _copy_of(F.col("sample_id"), copies[True])).otherwise(
        _copy_of(F.col("sample_id"), copies[False]))
    last = F.when(F.col(ORIGINAL_FLAG), F.lit(copies[True] - 1)).otherwise(F.lit(copies[False] - 1))
    full = (flagged.withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
            .drop(ORIGINAL_FLAG) if max(copies.values()) > 1
            else flagged.withColumn("_copy", F.lit(0)).drop(ORIGINAL_FLAG))
    return placed.withColumn("_copy", copy).join(full, [key, "_copy"]).drop("_copy")


# --- R7 ----------------------------------------------------------------------
def balance_summary(balanced: DataFrame) -> DataFrame:
    """Per class: rows selected and rows in the combined set."""
    per = balanced.groupBy(ORIGINAL_FLAG).agg(F.count(F.lit(1)).alias("selected"))
    tot = balanced.agg(F.count(F.lit(1)).alias("combined"))
    return per.crossJoin(F.broadcast(tot)).select(
        F.when(F.col(ORIGINAL_FLAG), F.lit(T.ORIGINAL)).otherwise(F.lit("other")).alias("class"),
        "selected", "combined")


# --- R8 ----------------------------------------------------------------------
def shuffle_positions(df: DataFrame, key: str, seed: int = 0,
                      position: str = "position") -> DataFrame:
    """Seeded permutation: 1-based ``position`` of every row."""
    return hash_rank(df, seed, key, name=position)


def write_shuffled(df: DataFrame, path: str, position: str = "position",
                   fmt: str = "json", partitions: int | None = None) -> None:
    """Write rows in ``position`` order: range partitions + local sort (files
    ``part-00000 ...`` concatenate to the permutation)."""
    n = partitions or default_parallelism(df.sparkSession)
    out = df.repartitionByRange(n, position).sortWithinPartitions(position)
    out.write.mode("overwrite").option("ignoreNullFields", "false").format(fmt).save(path)


# --- R10 / R11 ---------------------------------------------------------------
def train_val_split(df: DataFrame, key: str, seed: int = 42, test_size: float = 0.2,
                    split: str = "split") -> DataFrame:
    """``ceil(test_size * n)`` rows -> 'validation', the rest -> 'train'."""
    r = hash_rank(df, seed, key, name="_rk")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    return (r.crossJoin(F.broadcast(n))
            .withColumn(split, F.when(F.col("_rk") <= cut, F.lit("validation"))
                        .otherwise(F.lit("train")))
            .drop("_rk", "_n"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))

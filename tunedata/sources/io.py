"""Sources and sinks: problem directories, JSON lines, JSON arrays, appends,
line indexes.

All readers are Spark readers (splittable where the format allows), except that
tasks list and read local problem folders themselves; all writers are DataFrame
writers. Scratch data goes under the cluster's shared
checkpoint folder (``session.scratch_path``), never a machine-local folder.
"""

from __future__ import annotations

import bz2
import gzip
import os
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tunedata.functions.text import normalize_newlines, strip
from tunedata.operators.rank import range_rank
from tunedata.session import default_parallelism, table_exists

CORRUPT = "_corrupt_record"


# --- S1 ----------------------------------------------------------------------
def read_problem_dirs(spark: SparkSession, root: str, filename: str = "question.txt",
                      partitioned: bool = False) -> DataFrame:
    """``<root>/<id>/<filename>`` -> (problem_id, text); ``filename`` is a glob.

    Folders without the file are skipped, as are empty files and hidden names;
    the text is read whole, ``\\r\\n`` normalised and stripped as upstream. The
    id is the folder name; with ``partitioned`` the folders are the
    ``name=value`` ones of a partitioned Spark write, and the id is the value.

    Local and mounted folders are listed and read by tasks
    (``folders.files_in_folders``): Spark's reader holds every file of every
    folder in the driver's memory. Other file systems go through that reader."""
    base = root.rstrip("/")
    plain = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", base)
    if re.match(r"file:|/", root) and os.path.isdir(plain):
        from tunedata.sources.folders import files_in_folders
        pattern = glob_pattern(filename)
        raw = files_in_folders(
            spark, plain, _shown_folder, lambda name: _shown_file(name) and pattern.fullmatch(name) is not None,
            lambda folder, name, content: (folder, _unpacked(name, content)) if content else None,
            "folder string, value binary", filename if _PLAIN.fullmatch(filename) else None)
        # bytes that are not UTF-8 stay as they are
        raw, folder = raw.select("folder", F.col("value").cast("string").alias("value")), F.col("folder")
    else:
        raw, folder = _spark_problem_dirs(spark, base, plain, filename)
    if partitioned:
        folder = F.regexp_replace(folder, r"^[^=]*=", "")
    return raw.select(folder.alias("problem_id"), strip(normalize_newlines("value")).alias("text"))


def _spark_problem_dirs(spark: SparkSession, base: str, plain: str, filename: str) -> tuple[DataFrame, Column]:
    # Recursive listing runs as a parallel Spark job (no driver-side glob over
    # every folder). Its default parallelism is one task per folder (up to
    # 10,000 tiny tasks); a few tasks per core list the same folders faster.
    # The path filter keeps exactly <root>/<id>/<file>.
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, str(max(8, 2 * default_parallelism(spark))))
    try:
        raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", filename)
               .text(base, wholetext=True))
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)
    # file_path is URL-encoded ('+' stands for itself there); the root is not,
    # unless it was given as a URL
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    one_level = F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 2)).endswith(plain)
    return raw.where(one_level), F.element_at(parts, -2)


_PLAIN = re.compile(r"[^\\/*?\[\]{}]+")


def glob_pattern(glob: str) -> re.Pattern:
    """What Spark's ``pathGlobFilter`` matches whole names by: ``*``, ``?``,
    ``[ab]``, ``[!a-c]``, ``{one,two}``, ``\\`` before a sign that stands for
    itself."""
    out, groups, inside, i = [], 0, False, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"nothing after the last \\ in {glob!r}")
            out.append(re.escape(glob[i]))
        elif inside:
            inside = c != "]"
            out.append("^" if c == "!" and glob[i - 1] == "[" else "\\[" if c == "[" else c)
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "{":
            groups += 1
            out.append("(?:")
        elif groups and c in ",}":
            groups -= c == "}"
            out.append("|" if c == "," else ")")
        else:
            out.append(re.escape(c))
        i += 1
    if inside or groups:
        raise ValueError(f"unclosed class or group in {glob!r}")
    return re.compile("".join(out), re.DOTALL)


def _shown_folder(name: str) -> bool:
    """Whether Spark lists a folder of that name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_"))


def _shown_file(name: str) -> bool:
    return _shown_folder(name) and not (name.startswith("_") and "=" not in name)


def _unpacked(name: str, content: bytes) -> bytes:
    """As Spark's reader does by the end of the name."""
    if name.endswith(".gz"):
        return gzip.decompress(content)
    if name.endswith(".bz2"):
        return bz2.decompress(content)
    if name.endswith(".deflate"):
        return zlib.decompress(content)
    if name.endswith((".zst", ".lz4", ".snappy")):
        raise ValueError(f"read_problem_dirs: {name!r} is packed in a form that is not read here")
    return content


def write_problem_dirs(df: DataFrame, root: str, key: str = "problem_id",
                       text: str = "text") -> None:
    """One folder per problem (``<root>/<key>=<id>/part-*.txt``).

    An explicit partition count keeps every core writing: with a plain
    ``repartition(key)`` AQE would coalesce small data into one task that
    then creates every folder alone.

    On local and mounted folders tasks write their files themselves
    (``folders.write_partitioned_lines``): Spark's writer starts several
    processes a file there, and its driver moves one file after the other."""
    n = 2 * default_parallelism(df.sparkSession)
    if re.match(r"file:|/", root):
        from tunedata.sources.folders import write_partitioned_lines
        write_partitioned_lines(df, root, key, text, n)
        return
    (df.select(key, text).repartition(n, key).write.mode("overwrite")
     .partitionBy(key).text(root))


# --- S2 / S4 -----------------------------------------------------------------
def read_jsonl(spark: SparkSession, path: str, schema: ST.StructType,
               keep_corrupt: bool = True) -> DataFrame:
    """JSON lines with a declared schema. A bad line does not abort the job:
    it lands in ``_corrupt_record`` (other fields null)."""
    s = schema
    if keep_corrupt and CORRUPT not in schema.fieldNames():
        s = ST.StructType(schema.fields + [ST.StructField(CORRUPT, ST.StringType())])
    return (spark.read.schema(s).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def valid_rows(df: DataFrame) -> DataFrame:
    """Drop corrupt lines (downstream operators only see parsed rows).

    The filter also reads a data column: Spark rejects a JSON scan whose only
    referenced column is the corrupt-record column (e.g. a bare count)."""
    if CORRUPT not in df.columns:
        return df
    data = [c for c in df.columns if c != CORRUPT]
    keep = F.col(CORRUPT).isNull()
    if data:
        keep = keep & (F.size(F.array(F.col(data[0]).isNull())) > 0)
    return df.where(keep).drop(CORRUPT)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line; null fields are written as null (upstream keeps
    them), not dropped as Spark does by default."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


# --- S3 ----------------------------------------------------------------------
def read_json_array(spark: SparkSession, path: str, schema: ST.StructType | None = None) -> DataFrame:
    """Files holding one JSON array each (one task per file, not splittable)."""
    r = spark.read.option("multiLine", "true")
    return (r.schema(schema) if schema is not None else r).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str,
                      bytes_per_file: int = 16 << 20) -> None:
    """Write rows as JSON-array files of about ``bytes_per_file`` bytes: rows
    are hashed into buckets by the measured bytes of all rows, and each bucket
    becomes one array document sorted by ``key``, in its own folder
    ``<path>/bucket=<b>/`` (read back with ``read_json_array(path + '/*')``).
    The form is the same at every size; a document holds whole rows, so one
    row over the limit makes a document of its own size."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    total = df.select(F.octet_length(line).alias("n")).agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // bytes_per_file))
    b = F.pmod(F.xxhash64(F.col(key), line), F.lit(files))
    doc = (df.select(b.alias("_b"), F.struct(F.col(key).alias("k"), line.alias("j")).alias("_e"))
           .groupBy("_b").agg(F.sort_array(F.collect_list("_e")).alias("_a")))
    text = F.concat(F.lit("["), F.array_join(F.transform("_a", lambda e: e["j"]), ","), F.lit("]"))
    # one folder per bucket, one row (= one document) per folder
    (doc.select(text.alias("value"), F.col("_b").alias("bucket")).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").text(path))


# --- S5 ----------------------------------------------------------------------
def append_dataset(spark: SparkSession, path: str, rows: DataFrame, key: str,
                   fmt: str = "parquet") -> DataFrame:
    """Add ``rows`` whose ``key`` is not yet in the dataset at ``path``
    (created if missing), then return the whole dataset. Idempotent: a rerun
    with the same rows adds nothing, rows with a null key included."""
    new = rows
    if table_exists(spark, path):
        existing = spark.read.format(fmt).schema(rows.schema).load(path)
        have = existing.select(F.col(key).alias("_have")).distinct()
        new = rows.join(have, rows[key].eqNullSafe(have["_have"]), "left_anti")
    new.write.mode("append").format(fmt).save(path)
    return spark.read.format(fmt).schema(rows.schema).load(path)


# --- S6 ----------------------------------------------------------------------
def index_nonempty(df: DataFrame, order_key: str, output: str = "output",
                   index: str = "idx") -> DataFrame:
    """0-based ``index`` in ``order_key`` order, assigned *before* rows with a
    missing or empty ``output`` are dropped (so numbering has gaps).

    The ranks are worked out on the keys alone, in range partitions whose
    number follows the data, and joined back; two rows with one key are an
    error, a null key comes last."""
    once = F.when(F.count(F.lit(1)) == 1, F.lit(0)).otherwise(
        F.raise_error(F.lit(f"index_nonempty: several rows share one {order_key}")))
    keys = df.groupBy(F.col(order_key).alias("_key")).agg(once.alias("_once"))
    ranks = range_rank(keys.select("_key", "_once"), [F.asc_nulls_last("_key")], "_rk").select(
        "_key", (F.col("_rk") - 1).alias(index))
    kept = df.where(F.col(output).isNotNull() & (F.length(output) > 0))
    return kept.join(ranks, kept[order_key].eqNullSafe(ranks["_key"])).drop("_key")

"""Named files in folders: ``<root>/<id>/<name>``, read and written as a table.

Spark's own writers choose their file names, so a text that must stand in a
file of a given name needs a data source of its own. It takes rows (``id``,
``name``, ``text``); tasks write their rows' files themselves, each under
another name first and then moved into place, so a file is whole or absent and
a task that runs twice leaves the same files. Ids and names become one path
segment each, whatever they hold.

They are read the same way: tasks list the folders, each a share of the names,
which are written to the shared folder, and tasks read the files of so many
folders. The driver holds neither names nor files, however many there are.

Paths are those that ``pyarrow.fs`` opens: absolute local (or mounted) paths and
the ``file``, ``s3``, ``gs``, ``abfss`` and ``hdfs`` schemes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tunedata.session import default_parallelism, materialize, ship_package
from tunedata.sources.io import index_nonempty

FORMAT = "named_folders"
LINES_FORMAT = "partitioned_lines"
#: Folders that one task reads or writes.
FOLDERS_PER_TASK = 1_000
#: Tasks that list one root, each all its names, at most.
LISTING_TASKS = 32
#: Names, or bytes of files, that a task hands on at once.
NAMES_AT_ONCE, BYTES_AT_ONCE = 10_000, 4 << 20


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _segment(name: str) -> str:
    """One path segment for any name: no separator, not '.', '..', empty or a
    name that Spark or this module hides (leading '.' or '_')."""
    safe = quote(name, safe=" ")
    if safe[:1] in (".", "_", ""):
        safe = "%" + format(ord(name[0]), "02X") + safe[1:] if name else "%00"
    return safe


def _name(segment: str) -> str:
    return "" if segment == "%00" else unquote(segment)


def _local(system) -> bool:
    from pyarrow import fs
    return isinstance(system, fs.LocalFileSystem)


def _names(root: str) -> Iterator[bytes]:
    """Names of the folders right under ``root``. A local folder is listed as a
    stream, so that no list of all names is held."""
    from pyarrow import fs
    system, path = _open(root)
    if _local(system):
        with os.scandir(os.fsencode(path)) as entries:
            yield from (e.name for e in entries if e.is_dir())
    else:
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.Directory:
                yield info.base_name.encode()


def _text(name: bytes) -> str:
    return name.decode("utf-8", "replace")


def _contents(root: str, folder: bytes, file: str | None, wanted: Callable[[str], bool]) -> Iterator[tuple[bytes, bytes]]:
    """Name and bytes of the files of ``folder`` that are ``wanted``, by name;
    of ``file`` alone, where one is given."""
    from pyarrow import fs
    system, path = _open(root)
    if _local(system):
        base = os.path.join(os.fsencode(path), folder)
        for name in [os.fsencode(file)] if file is not None else sorted(os.listdir(base)):
            if wanted(_text(name)) and os.path.isfile(at := os.path.join(base, name)):
                with open(at, "rb") as f:
                    yield name, f.read()
        return
    base = f"{path}/{_text(folder)}"
    found = system.get_file_info([f"{base}/{file}"] if file is not None else fs.FileSelector(base))
    for info in sorted(found, key=lambda i: i.path):
        if info.type == fs.FileType.File and wanted(info.base_name):
            with system.open_input_stream(info.path) as f:
                yield info.base_name.encode(), f.read()


def files_in_folders(spark: SparkSession, root: str, listed: Callable[[str], bool], wanted: Callable[[str], bool],
                     row: Callable[[str, str, bytes], tuple | None], schema: str, file: str | None = None) -> DataFrame:
    """A ``row`` (of ``schema``; None: no row) of folder, name and content for
    each of the ``wanted`` files (or for ``file`` alone) in the ``listed``
    folders right under ``root``.

    The folders are listed now: every listing task goes over all names of a
    local root and keeps its share by a hash (elsewhere listing is dear, and one
    task does it), and the names are written. The files are read when the
    result is, ``FOLDERS_PER_TASK`` folders a task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    ship_package(spark)
    shares = min(default_parallelism(spark), LISTING_TASKS) if _local(_open(root)[0]) else 1
    arrow = to_arrow_schema(ST.StructType.fromDDL(schema))

    def names(batches):
        for share in (x for batch in batches for x in batch.column(0).to_pylist()):
            some = []
            for name in _names(root):
                if crc32(name) % shares == share and listed(_text(name)):
                    some.append(name)
                    if len(some) == NAMES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["folder"])
                        some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["folder"])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def contents(batches):
        rows, size = [], 0
        for folder in (x for batch in batches for x in batch.column(0).to_pylist()):
            for name, content in _contents(root, folder, file, wanted):
                made = row(_text(folder), _text(name), content)
                if made is not None:
                    rows.append(made)
                    size += len(content) + 100
                    if size >= BYTES_AT_ONCE:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    folders = materialize(spark.range(0, shares, 1, shares).mapInArrow(names, "folder binary"), "folder-names")
    # an explicit number, as Spark would put short names into one task
    tasks = max(1, -(-folders.count() // FOLDERS_PER_TASK))
    return folders.repartition(tasks, "folder").mapInArrow(contents, schema)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        for row in rows:
            if row["id"] is None or row["name"] is None:
                raise ValueError("named_folders: id and name must not be null")
            folder = f"{root}/{_segment(row['id'])}"
            system.create_dir(folder, recursive=True)
            part = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            system.move(part, f"{folder}/{_segment(row['name'])}")
        return WriterCommitMessage()


class NamedFolders(DataSource):
    """Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


#: What Spark's own writer escapes in the name of a partition's folder.
_ESCAPED = {chr(c) for c in range(1, 32)} | set('"#%\'*/:=?\\{[]^') | {chr(127)}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partition_folder(key: str, value: str | None) -> str:
    """``key=value`` as Spark names the folder of a partition."""
    def escaped(name):
        return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)
    return f"{escaped(key)}={escaped(value) if value else NO_VALUE}"


class _LinesWriter(DataSourceWriter):
    """A text file for each folder among a task's rows, which come sorted by
    folder; a line for each row."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.key = options["key"]
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from itertools import groupby

        from pyspark import TaskContext
        system, root = _open(self.path)
        task = TaskContext.get().partitionId()
        for name, lines in groupby(rows, key=lambda r: partition_folder(self.key, r["value"])):
            folder = f"{root}/{name}"
            system.create_dir(folder, recursive=True)
            part = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                for r in lines:
                    f.write((r["text"] or "").encode("utf-8", "surrogatepass") + b"\n")
            # the same name if the task runs again
            system.move(part, f"{folder}/part-{task:05d}-{self.job}.txt")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        system.open_output_stream(f"{root}/_SUCCESS").close()


class PartitionedLines(DataSource):
    """Options: ``path`` and ``key``, the name of the partition column."""

    @classmethod
    def name(cls) -> str:
        return LINES_FORMAT

    def schema(self) -> str:
        return "value string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LinesWriter(dict(self.options))


def write_partitioned_lines(df: DataFrame, root: str, key: str, text: str, tasks: int) -> None:
    """What ``partitionBy(key).text(root)`` writes in place of what is there, in
    ``tasks`` tasks: ``<root>/<key>=<value>/part-*.txt``, a line a row."""
    from pyarrow import fs
    system, base = _open(root)
    if system.get_file_info([base])[0].type == fs.FileType.Directory:
        system.delete_dir_contents(base)
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(PartitionedLines)
    rows = df.select(F.col(key).cast("string").alias("value"), F.col(text).alias("text"))
    (rows.repartition(tasks, "value").sortWithinPartitions("value").write.format(LINES_FORMAT)
     .option("key", key).mode("append").save(root))


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(NamedFolders)
    return spark


def _shown(name: str) -> bool:
    return name[:1] not in (".", "_")


def read_named(spark: SparkSession, root: str, file: str | None = None) -> DataFrame:
    """``id``, ``name``, ``text`` of the files in the folders right under
    ``root``; deeper folders, files beside them and hidden ones are left out."""
    return files_in_folders(
        spark, root.rstrip("/"), _shown, _shown,
        lambda folder, name, content: (_name(folder), _name(name), content.decode("utf-8", "replace")),
        "id string, name string, text string", _segment(file) if file is not None else None)


def write_named(df: DataFrame, root: str, id_: str = "id", text: str = "text",
                name: str = "question.txt") -> None:
    """Each row as ``<root>/<id>/<name>``; null texts are empty files. Files that
    are there are replaced, others stay. Two rows with one id are an error,
    found before anything is written."""
    rows = df.select(F.col(id_).cast("string").alias("id"), F.lit(name).alias("name"),
                     F.col(text).cast("string").alias("text"))
    twice = F.when((F.col("count") > 1) | F.col("id").isNull(), F.struct("id"))
    seen = rows.groupBy("id").count().agg(F.first(twice, ignorenulls=True).alias("twice"), F.sum("count").alias("n")).first()
    if seen["twice"] is not None:
        raise ValueError(f"write_named: id {seen['twice']['id']!r} is null or names several rows")
    _registered(df.sparkSession)
    # dealt out by id, in tasks of so many folders: an explicit number, as Spark
    # would put rows of few bytes into one task that makes all folders alone
    tasks = max(2 * default_parallelism(df.sparkSession), -(-(seen["n"] or 0) // FOLDERS_PER_TASK))
    rows.repartition(tasks, "id").write.format(FORMAT).mode("append").save(root)


def export_nonempty(df: DataFrame, root: str, order_key: str, output: str = "output",
                    name: str = "modified_question.txt") -> DataFrame:
    """S6 to its end: the non-empty outputs as ``<root>/<index>/<name>``, numbered
    before the empty ones are dropped. Returns what was written (``idx``, text)."""
    rows = index_nonempty(df, order_key, output).select("idx", output)
    write_named(rows, root, "idx", output, name)
    return rows

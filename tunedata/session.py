"""Session helpers: a tuned local session for tests and the bench, and the
shared scratch location every job that writes intermediate data uses."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tunedata") -> SparkSession:
    """Local session used by tests and ``bench.py`` (a cluster brings its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        return None


def default_parallelism(spark: SparkSession, fallback: int = 8) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", str(fallback)))


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "app")


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session; only when nothing is configured and the master is
    local (tests) a private folder is created and registered as the checkpoint
    dir. On a cluster a folder of the driver's machine would lose rows, so
    there a missing setting is an error.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.match(r"local(\[[^,\]]*(,\s*\d+)?\])?$", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tunedata-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(root)
        else:
            spark.conf.set("spark.checkpoint.dir", root)
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from the files instead of the work that made them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything can be read at ``path``; other errors are raised."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tunedata`` importable in Python workers (once per application).

    Only Python-backend generation needs this: its ``mapInPandas`` function
    refers to this package. The zip is built on the driver and distributed by
    Spark (``addPyFile``), the same way ``--py-files`` ships code.
    """
    key = app_id(spark)
    if key in _SHIPPED:
        return
    import tunedata
    pkg = os.path.dirname(os.path.abspath(tunedata.__file__))
    build = tempfile.mkdtemp(prefix="tunedata-pkg-")
    archive = shutil.make_archive(os.path.join(build, "tunedata"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="tunedata")
    sc = _context(spark)
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(key)

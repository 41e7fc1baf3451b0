"""Test views over the driver's tables (identical SQL text runs in DuckDB).

``records``       user turn followed by an assistant turn (problem/answer/type)
``requests_open`` user turn without an assistant reply (output = '')
``problems``      documents as problems
``classed``       labelled documents, quality 1 -> Original, 0 -> Incomplete
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.operators.windows import lead_in_group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: record_id = conv_id * TURNS + turn: no conversation has so many turns
TURNS = 2 ** 32

# Derived views are written once per session into the shared checkpoint
# folder and read back as parquet (a written table cuts the lineage: queries
# that use a view several times do not recompute its windows and joins).
# The key holds path, length and modification time of every source file as
# Spark itself lists them, on any file system, so a changed input is never
# served from an old copy.
_WRITTEN: dict[tuple, str] = {}


def _signature(spark: SparkSession, sf_dir: str, sources: tuple[str, ...]) -> tuple:
    sig = []
    for t in sources:
        # a row a file: the reader lists files and does not open them
        files = (spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{t}.parquet")
                 .select("path", "length", "modificationTime"))
        # one number for all files, however many there are
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"),
                        F.bit_xor(F.xxhash64(*files.columns)).alias("h")).first()
        sig.append((t, row["n"], row["size"], row["h"]))
    return tuple(sig)


def _written(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...],
             build) -> DataFrame:
    from tunedata.session import app_id, scratch_path
    key = (app_id(spark), sf_dir.rstrip("/"), name, _signature(spark, sf_dir, sources))
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, f"view-{name}")
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lead() by conversation, with windows bounded by turn ranges so a very
    # long conversation is not one task (operators.windows).
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return lead_in_group(conv, "conv_id", "turn", ["role", "text"])


def _type_by_conv() -> F.Column:
    m = F.col("conv_id") % 4
    return (F.when(m == 0, "Original").when(m == 1, "Ambiguous")
            .when(m == 2, "Inconsistent").otherwise("Incomplete"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "records", ("conversations",),
                    lambda: _records(spark, sf_dir))


def requests_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "requests_open", ("conversations",),
                    lambda: _requests_open(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _turns(spark, sf_dir)
    return x.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("record_id"),
        F.col("text").alias("problem"),
        F.col("next_text").alias("answer"),
        _type_by_conv().alias("type"),
    )


def _requests_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _turns(spark, sf_dir)
    return x.where((F.col("role") == "user")
                   & (F.coalesce(F.col("next_role"), F.lit("")) != "assistant")).select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("record_id"),
        F.col("text").alias("input"),
        F.lit("").alias("output"),
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "classed", ("labels", "documents"),
                    lambda: _classed(spark, sf_dir))


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return labels.join(docs, "doc_id").select(
        "doc_id", "text",
        F.when(F.col("quality") == 1, "Original").otherwise("Incomplete").alias("type"),
    )


# The same views as DuckDB SQL (CTE bodies), used by the oracle queries.
SQL_VIEWS = {
    "records": """
SELECT conv_id * 4294967296 + turn AS record_id, text AS problem, next_text AS answer,
       CASE conv_id % 4 WHEN 0 THEN 'Original' WHEN 1 THEN 'Ambiguous'
                        WHEN 2 THEN 'Inconsistent' ELSE 'Incomplete' END AS type
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'""",
    "requests_open": """
SELECT conv_id * 4294967296 + turn AS record_id, text AS input, '' AS output
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
      FROM conversations) x
WHERE role = 'user' AND coalesce(next_role, '') <> 'assistant'""",
    "problems": "SELECT doc_id, text FROM documents",
    "classed": """
SELECT l.doc_id, d.text,
       CASE WHEN l.quality = 1 THEN 'Original' ELSE 'Incomplete' END AS type
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"

"""Every registered query against its DuckDB oracle (sf0.001) and the entry."""
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tunedata.plans.catalog import ORACLE, QUERIES

TABLES = "documents labels conversations benchmark pages".split()
NO_ORACLE: set[str] = set()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_key_has_oracle_or_reason():
    assert set(QUERIES) - set(ORACLE) == NO_ORACLE


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, con, key):
    df = QUERIES[key](spark, SF001)
    rows = Counter(tuple(_norm(x) for x in r) for r in df.collect())
    rel = con.sql(ORACLE[key])
    assert sorted(df.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in df.columns]
    orows = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert rows == orows


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"record_id", "problem", "answer", "type", "position"} <= set(df.columns)


@pytest.mark.parametrize("key", ["balance_downsample", "cross_class_rejected", "length_batches",
                                 "encode", "perplexity", "index_nonempty", "build_vocab"])
def test_result_independent_of_shuffle_partitions(spark, key):
    out = []
    for parts in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = QUERIES[key](spark, SF001)
        out.append(Counter(tuple(_norm(x) for x in r) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]

"""Plan shape: no data-sized single-partition exchange, no Python outside the
generation hook, pushdown/pruning reach the scan."""
import pytest

from conftest import SF001
from tunedata.plans.catalog import QUERIES

# bounded single-partition steps: rank-offset tables (<= 65,536 buckets),
# vocabulary ids (<= cap rows), one-row aggregates
BOUNDED = ("_rk_b", "TakeOrderedAndProject", "token")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_ok(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            window = "\n".join(lines[i:i + 8])
            if not any(b in window for b in BOUNDED) and "HashAggregate(keys=[]" not in window \
                    and "keys=[]" not in window:
                return False
    return True


@pytest.mark.parametrize("key", ["shuffle_positions", "balance_downsample", "train_val_split",
                                 "build_dataset", "build_batches", "encode", "perplexity",
                                 "length_batches", "cross_class_rejected"])
def test_no_data_sized_single_partition(spark, key):
    df = QUERIES[key](spark, SF001)
    assert _single_partition_ok(_plan(df)), _plan(df)


def test_python_only_in_generation_hook(spark):
    for key, fn in QUERIES.items():
        if key in ("generation_status",):
            continue
        plan = _plan(fn(spark, SF001))
        for marker in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert marker not in plan, (key, marker)
    # a client's answers are written as they come: the result reads them
    answers = _plan(QUERIES["generation_status"](spark, SF001))
    assert "Scan parquet" in answers and "MapInPandas" not in answers


def test_pruning_reaches_scan(spark):
    df = QUERIES["type_counts"](spark, SF001)
    plan = _plan(df)
    assert "ReadSchema: struct<type:string>" in plan          # only the grouped column
    docs = QUERIES["entropy"](spark, SF001)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in _plan(docs)

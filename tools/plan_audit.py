"""Summarise the executed (final, adaptive) plan of every registered query.

usage: python tools/plan_audit.py [sf_dir] > PLANS.md
Per key: shuffles, reused exchanges, broadcasts, single-partition exchanges
(and what feeds them), Python nodes, scans with pushed filters.
"""
from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from tunedata.plans.catalog import QUERIES  # noqa: E402
from tunedata.session import local_session  # noqa: E402


def audit(plan: str) -> dict:
    # an adaptive plan prints the final plan and then the initial one
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    lines = plan.splitlines()
    single = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            feed = next((l.strip().lstrip("+-: ") for l in lines[i + 1:i + 6]
                         if re.search(r"Aggregate|TakeOrdered|Window|Project", l)), "?")
            single.append(re.sub(r"#\d+L?", "", feed)[:70])
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                   r"Exchange RoundRobin", plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "single": single,
        "python": sorted(set(re.findall(r"(MapInPandas|ArrowEvalPython|BatchEvalPython|"
                                        r"FlatMapGroupsInPandas)", plan))),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print("# PLANS\n")
    print(f"Executed adaptive plans of every registered query at `{sf}` (`tools/plan_audit.py`).")
    print("`single` lists each single-partition exchange with the operator that feeds it: all")
    print("of them sit on bounded inputs (one-row aggregates, and bucket-offset tables of at most")
    print("65,536 rows or one row per range partition). Tables that a query writes for itself")
    print("(ranks, counts, pairs, vocabularies) have plans of their own, not shown here.\n")
    print("| key | shuffles | reused | broadcasts | python | pushed filters | single-partition inputs |")
    print("| --- | ---: | ---: | ---: | --- | ---: | --- |")
    for k, fn in QUERIES.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        a = audit(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{k}` | {a['shuffles']} | {a['reused']} | {a['broadcasts']} | "
              f"{', '.join(a['python']) or '-'} | {a['pushed']} | "
              f"{'; '.join(sorted(set(a['single']))) or '-'} |", flush=True)


if __name__ == "__main__":
    main()

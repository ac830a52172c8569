"""Every query with SQL gives the rows of its SQL; none needs a pairwise join."""
import re

import pytest

from checks.compare import compare
from checks.registry import ORACLES, QUERIES
import __spark_entry__  # noqa: F401  (registers the queries)

SF = "/root/testdata/sf0.001"
OWN = [n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)]   # the others have tests of their own


@pytest.mark.parametrize("name", sorted(set(OWN) & set(ORACLES)))
def test_same_rows_as_sql(spark, name):
    got = compare(spark, SF, [name])
    assert got[name].startswith("ok"), got[name]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6


# Operators that stand right on aggregated rows (joins: of aggregates, in report tables).
FEW = ("HashAggregate", "SortAggregate", "ObjectHashAggregate", "TakeOrdered", "Window", "Union", "Generate",
       "SortMergeJoin", "BroadcastHashJoin", "Expand", "AdaptiveSparkPlan")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


EAGER = ("s1_csv", "j3", "s4", "s5", "s6", "s7", "b4", "b7", "b8", "p10", "p13", "t13", "t7", "t8", "t9", "t10", "m3", "m4", "m5", "m6_model_c", "m7", "m16", "d6")
LAZY = sorted(n for n in OWN if not n.startswith(EAGER))


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_pairwise_join_and_no_window_over_cases(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = [re.sub(r"^[\s:+\-|]*(\*\(\d+\) )?", "", line) for line in text.splitlines()]
    for at, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            below = next(x for x in lines[at + 1:] if not x.startswith(("Project", "Filter", "Subquery", "ReusedSubquery", "Sort [")))
            # one task only ever sees rows that an aggregation has already made few
            assert below.startswith(FEW), (line, below)


def test_strongest_rows_are_cut_before_the_exchange(spark):
    text = plan(QUERIES["w6_strongest_per_theme"](spark, SF))
    assert re.search(r"WindowGroupLimit .* Partial", text)


def test_filters_and_columns_reach_the_scan(spark):
    from checks.adapters import cases_rel

    text = plan(cases_rel(spark, SF, "").where("timely = 1").select("relief"))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    # l_orderkey only because one small file is spread over the cores
    assert {c.split(":")[0] for c in columns.split(",")} == {"l_orderkey", "l_discount", "l_returnflag", "l_linestatus"}
    scan = text.index("FileScan")
    assert "l_discount" in text[text.rindex("Filter", 0, scan):scan]   # filtered before the exchange

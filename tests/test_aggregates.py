"""Aggregates whose plan must not hold wide state for each key, on rows with nulls and repeats."""

import re
from datetime import datetime
from types import SimpleNamespace

from lakeweave.operators.relational import REL
from lakeweave.plans import ssb


def test_sketches_are_not_kept_for_each_distinct_key(spark):
    rows = [("A", k // 3, float(k % 50)) for k in range(900)] + [(None, k, 7.0) for k in range(40)] + [("N", None, None), ("R", None, 3.0), ("R", 5, None)]
    lines = spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_quantity double").repartition(3)
    out = REL["rel_aggregate_approximate"].run(SimpleNamespace(lineitem=lines))
    assert {tuple(r) for r in out.collect()} == {("A", True, True), (None, True, True), ("N", True, None), ("R", True, True)}
    sketched = re.findall(r"ObjectHashAggregate\(keys=\[(.*?)\]", out._jdf.queryExecution().sparkPlan().toString())
    assert sketched and not any("l_orderkey" in keys for keys in sketched)


def test_orders_are_counted_in_bounded_tasks(spark, monkeypatch):
    """Lines are dealt by order in as many partitions as they fill; repeated customers and orders and null dates count as in the SQL."""
    at = datetime(1996, 5, 1)
    tables = {
        "region": spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "c_custkey long, c_nationkey long"),
        "part": spark.createDataFrame([(7, "Brand#11", "P"), (8, "Brand#11", None)], "p_partkey long, p_brand string, p_type string"),
        "orders": spark.createDataFrame([(10, 1, at), (11, 2, at), (11, 2, at), (12, 2, None), (13, 2, at)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(o, p, 3, 2.0, 5.0, 0.1) for o, p in ((10, 7), (10, 7), (11, 8), (12, 7), (13, 8), (None, 7))], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double"),
    }
    monkeypatch.setattr(ssb, "LINES_OF_A_TASK", 1)
    out = ssb.SSB["ssb_qv1_1"].run(SimpleNamespace(spark=spark, **tables))
    assert [tuple(r) for r in out.collect()] == [("N", None, 1996, 6.0, 15.0, 2, 1, 1, 3), ("N", "P", 1996, 8.0, 20.0, 1, 1, 0, 4)]
    assert re.search(r"RepartitionByExpression \[lo_orderkey#\d+L?\], 6\b", out._jdf.queryExecution().optimizedPlan().toString())

"""Queries over shards: how rows are dealt out, what follows them, and results by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import shard_by_remainder
from lakeweave.plans import Registry
from lakeweave.plans.ssb import Star
from lakeweave.plans.tpch import money
from lakeweave.session import summarize
from lakeweave.sources.catalog import Tables
from lakeweave.sources.shards import ORDERS_TREE, SHARD, STAR_TREE, sharded
from lakeweave.streaming import windowed

N = 11
SHARDS = Registry("shard_", f"WITH o AS (SELECT *, CAST(o_custkey % {N} + 1 AS INT) AS shard_number FROM orders), l AS (SELECT lineitem.*, shard_number FROM lineitem JOIN o ON o_orderkey = l_orderkey) ")
STREAM = Registry("stream_")


def _dealt(t: Tables) -> dict[str, DataFrame]:
    # by remainder: another engine cannot repeat Spark's hash
    return sharded(lambda name: getattr(t, name), ORDERS_TREE, N, shard_by_remainder)


@SHARDS("SELECT shard_number, COUNT(*) AS n FROM o GROUP BY shard_number")
def root_sizes(t: Tables) -> DataFrame:
    return _dealt(t)["orders"].groupBy(SHARD).agg(F.count("*").alias("n"))


@SHARDS("SELECT shard_number, COUNT(*) AS n, COUNT(DISTINCT p_partkey) AS parts FROM (SELECT DISTINCT shard_number, p_partkey FROM l JOIN part ON p_partkey = l_partkey) GROUP BY shard_number")
def following_parts(t: Tables) -> DataFrame:
    return _dealt(t)["part"].groupBy(SHARD).agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@SHARDS("SELECT shard_number, n_name, COUNT(*) AS n FROM (SELECT DISTINCT shard_number, s_suppkey, n_name FROM l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY ALL")
def whole_table_join(t: Tables) -> DataFrame:
    dealt = _dealt(t)
    return dealt["supplier"].join(dealt["nation"], F.col("s_nationkey") == F.col("n_nationkey")).groupBy(SHARD, "n_name").agg(F.count("*").alias("n"))


@SHARDS("SELECT shard_number, l_returnflag, ROUND(SUM(l_quantity), 2) AS q, COUNT(*) AS n FROM l GROUP BY ALL")
def results_by_shard(t: Tables) -> DataFrame:
    return _dealt(t)["lineitem"].groupBy(SHARD, "l_returnflag").agg(money(F.sum("l_quantity"), "q"), F.count("*").alias("n"))


@SHARDS("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean, MAX(l_extendedprice) AS high FROM lineitem GROUP BY ALL")
def summarized(t: Tables) -> DataFrame:
    parts = _dealt(t)["lineitem"].groupBy(SHARD, "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_extendedprice").alias("high"))
    out = summarize(parts, ["l_returnflag"], {"mean": "avg:q:n", "high": "max", "q": "sum", "n": "count"})
    return out.select("l_returnflag", money(F.col("q"), "q"), "n", F.round("mean", 6).alias("mean"), "high")


@SHARDS("SELECT shard_number, COUNT(*) AS n FROM l WHERE shard_number IN (2, 5) GROUP BY shard_number")
def active_subset(t: Tables) -> DataFrame:
    return _dealt(t)["lineitem"].where(F.col(SHARD).isin(2, 5)).groupBy(SHARD).agg(F.count("*").alias("n"))


@SHARDS("SELECT shard_number, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM l GROUP BY shard_number")
def star(t: Tables) -> DataFrame:
    """The star dealt out by customer: facts, and the parts and suppliers that they reach."""
    of = Star(t)
    tables = {"customer": of.people("c"), "lineorder": of.join(), "part": of.parts, "supplier": of.people("s"), "date_dim": of.orders.select("lo_orderdate", "d_year").distinct()}
    dealt = sharded(tables.__getitem__, STAR_TREE, N, shard_by_remainder)
    facts = dealt["lineorder"].groupBy(SHARD).agg(F.count("*").alias("n"))
    sizes = [dealt[name].groupBy(SHARD).agg(F.count("*").alias(f"{name}s")) for name in ("part", "supplier")]
    return facts.join(sizes[0], SHARD).join(sizes[1], SHARD)


@STREAM("SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(t: Tables) -> DataFrame:
    return windowed(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

"""Sharded copies of a data set: one root table dealt out by hash, its relatives following by key.

All shards are built together: a shard is a value of the column shard_number in a
partitioned Parquet table, and a reader of one shard prunes the rest. Small tables are
kept whole for every shard.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import shard_of

SHARD = "shard_number"


class ShardTable(NamedTuple):
    """How a table is sharded.

    Without a parent and with a key it is the root, dealt out by that key. With a parent it
    gets the rows whose key occurs as parent_key in the parent's shard, so it may overlap
    between shards; unique says that the parent has each key once. Without either it is
    whole in every shard.
    """

    name: str
    key: str | None = None
    parent: str | None = None
    parent_key: str | None = None
    unique: bool = False

    @property
    def mode(self) -> str:
        return "follow" if self.parent else "root" if self.key else "whole"


#: Orders dealt out by customer; what they reach follows.
ORDERS_TREE = (
    ShardTable("orders", "o_custkey"),
    ShardTable("lineitem", "l_orderkey", "orders", "o_orderkey", True),
    ShardTable("customer", "c_custkey", "orders", "o_custkey"),
    ShardTable("part", "p_partkey", "lineitem", "l_partkey"),
    ShardTable("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ShardTable("nation"),
    ShardTable("region"),
)
#: Customers dealt out by key; facts and their other dimensions follow.
STAR_TREE = (
    ShardTable("customer", "c_custkey"),
    ShardTable("lineorder", "lo_custkey", "customer", "c_custkey", True),
    ShardTable("part", "p_partkey", "lineorder", "lo_partkey"),
    ShardTable("supplier", "s_suppkey", "lineorder", "lo_suppkey"),
    ShardTable("date_dim"),
)

Read = Callable[[str], DataFrame]
Dealer = Callable[[Column, int], Column]


def _placed(rows: DataFrame, table: ShardTable, parent: DataFrame | None, shards: int, deal: Dealer) -> DataFrame:
    """A table with its shard_number, from its parent where it has one."""
    if table.mode == "whole":
        return rows
    if parent is None:
        return rows.withColumn(SHARD, deal(F.col(table.key), shards))
    reached = parent.select(F.col(table.parent_key).alias(table.key), SHARD)
    reached = reached if table.unique else reached.distinct()
    return rows.join(reached, table.key).select(*rows.columns, SHARD)


def sharded(read: Read, tree: tuple[ShardTable, ...], shards: int, deal: Dealer = shard_of) -> dict[str, DataFrame]:
    """Each table of the tree with shard_number, but for those kept whole. Parents stand before their children."""
    out: dict[str, DataFrame] = {}
    for table in tree:
        out[table.name] = _placed(read(table.name), table, out.get(table.parent), shards, deal)
    return out


def facts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows and an order-independent checksum of a table, by shard (0: whole), as one row for each shard."""
    shard = F.col(SHARD) if SHARD in rows.columns else F.lit(0)
    # kept as text: the sum of 64-bit hashes outgrows a long
    return rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[c for c in names if c != SHARD]).cast("decimal(38,0)")).cast("string").alias("checksum"))


def build_shards(spark: SparkSession, read: Read, tree: tuple[ShardTable, ...], shards: int, path: str, first: int = 1, last: int | None = None, overwrite: bool = False, deal: Dealer = shard_of) -> list[dict]:
    """Writes shards first..last of all tables below path, and a manifest; returns the manifest's entries.

    Rows are brought together by shard, and Spark splits or joins the parts by their size, so
    that a large shard is written by as many tasks as it needs. Existing tables are refused unless overwrite is set.
    """
    last = last or shards
    if not 1 <= first <= last <= shards:
        raise ValueError(f"shards {first}..{last} of {shards}")
    began, entries = time.strftime("%Y-%m-%dT%H:%M:%S"), []
    written: dict[str, DataFrame] = {}
    for table in tree:
        # children read what was written of their parents: no parent is worked out twice
        rows = _placed(read(table.name), table, written.get(table.parent), shards, deal)
        target, mode = f"{path}/{table.name}", "overwrite" if overwrite else "errorifexists"
        if table.mode == "whole":
            rows.write.mode(mode).option("compression", "zstd").parquet(target)
        else:
            rows = rows.where(F.col(SHARD).between(first, last))
            rows.hint("rebalance", F.col(SHARD)).write.mode(mode).option("compression", "zstd").partitionBy(SHARD).parquet(target)
        written[table.name] = spark.read.parquet(target)
        entries += [{"table": table.name, "mode": table.mode, **r.asDict()} for r in facts(written[table.name], sorted(written[table.name].columns)).orderBy("shard").collect()]
    head = {"shards": shards, "first": first, "last": last, "began": began, "ended": time.strftime("%Y-%m-%dT%H:%M:%S"), "spark": spark.version, "tree": [t._asdict() for t in tree]}
    spark.createDataFrame([(json.dumps({**head, "entries": entries}),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/manifest")
    return entries


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest that build_shards wrote."""
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def verify_shards(spark: SparkSession, path: str) -> list[str]:
    """What differs between the manifest and the files: missing or changed shards of each table; nothing if all is well."""
    entries, wrong = read_manifest(spark, path)["entries"], []
    for name in dict.fromkeys(e["table"] for e in entries):
        rows = spark.read.parquet(f"{path}/{name}")
        found = {r["shard"]: (r["rows"], r["checksum"]) for r in facts(rows, sorted(rows.columns)).collect()}
        for e in entries:
            if e["table"] == name and found.get(e["shard"]) != (e["rows"], e["checksum"]):
                wrong.append(f"{name}, shard {e['shard']}: manifest {e['rows']} rows, found {found.get(e['shard'], ('none',))[0]}")
    return wrong


class Shards:
    """Written shards: whole tables of chosen shards, or views of a single one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        manifest = read_manifest(spark, path)
        self.modes = {e["table"]: e["mode"] for e in manifest["entries"]}
        self.tree = tuple(ShardTable(**t) for t in manifest["tree"])
        self.numbers = list(range(manifest["first"], manifest["last"] + 1))

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """A table of one shard, without its shard number; of all shards together with it where number is None."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        if self.modes[name] == "whole" or number is None:
            return rows
        return rows.where(F.col(SHARD) == number).drop(SHARD)

    def subset(self, read: Read, numbers: list[int]) -> dict[str, DataFrame]:
        """Each table as far as the given shards reach it, every row once: the root's rows from those shards alone, the others from the whole tables by their parents' keys."""
        out: dict[str, DataFrame] = {}
        for table in self.tree:
            if table.mode == "root":
                out[table.name] = self.table(table.name).where(F.col(SHARD).isin(numbers)).drop(SHARD)
            elif table.mode == "follow":
                reached = out[table.parent].select(F.col(table.parent_key).alias(table.key))
                out[table.name] = read(table.name).join(reached, table.key, "left_semi").select(*read(table.name).columns)
            else:
                out[table.name] = read(table.name)
        return out

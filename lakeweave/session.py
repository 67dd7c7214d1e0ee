"""An SQL session over a data set: settings, the choice of how to run a query, and its result."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import register_functions
from lakeweave.plans.classify import classify, stripped
from lakeweave.sources.catalog import Tables, register
from lakeweave.sources.shards import SHARD, Shards
from lakeweave.users import authenticate

MODES = ("TRUE", "FALSE", "FORCE")


@dataclass
class Settings:
    """distributed: TRUE, FALSE or FORCE; summarize; active_shards: None for all; max_rows: rows shown, 0 for all."""

    distributed: str = "TRUE"
    summarize: bool = True
    active_shards: list[int] | None = None
    max_rows: int = 100

    def set(self, name: str, value: str) -> str:
        """Sets by name and returns what to tell the user; anything but TRUE turns summarize off."""
        if name == "distributed":
            if value.upper() not in MODES:
                raise ValueError(f"distributed must be one of {', '.join(MODES)}")
            self.distributed = value.upper()
        elif name == "summarize":
            self.summarize = value.upper() == "TRUE"
        elif name == "active_shards":
            self.active_shards = None if value.upper() == "ALL" else sorted({int(x) for x in value.split(",")})
        elif name == "max_rows":
            self.max_rows = max(0, int(value))
        else:
            raise ValueError(f"no setting is named {name}")
        return f"{name} is now {self.show(name)}"

    def show(self, name: str | None = None) -> str:
        """One setting's value, or a line for each."""
        values = {"distributed": self.distributed, "summarize": str(self.summarize).upper(), "active_shards": "ALL" if self.active_shards is None else ",".join(map(str, self.active_shards)), "max_rows": str(self.max_rows)}
        if name is None:
            return "\n".join(f"{k} = {v}" for k, v in values.items())
        if name not in values:
            raise ValueError(f"no setting is named {name}")
        return values[name]


def plan_distribution(settings: Settings, has_aggregates: bool, shards: int) -> tuple[str, list[str]]:
    """("shards" or "whole", the reasons why not by shard)."""
    if settings.distributed == "FORCE" and shards:
        return "shards", []
    reasons = []
    if not shards:
        reasons.append("no shards are at hand")
    if not has_aggregates:
        reasons.append("the query has no aggregates")
    if settings.distributed == "FALSE":
        reasons.append("distributed mode is off")
    return ("whole", reasons) if reasons else ("shards", [])


@dataclass
class QueryRun:
    """A query's DataFrame and how it came about; rows are fetched on demand."""

    text: str
    df: DataFrame | None = None
    mode: str = "whole"  # whole, shards (all of them together), subset (some together) or each
    reasons: list[str] = field(default_factory=list)
    status: str = "STARTED"
    problem: str | None = None
    seconds: float = 0.0

    def arrow(self, most: int = 0) -> pa.Table:
        """The result, or its first rows, as an Arrow table; notes the time taken."""
        if self.df is None:
            raise RuntimeError(self.problem)
        began = time.monotonic()
        try:
            table = (self.df.limit(most) if most else self.df).toArrow()
        except Exception:
            self.status = "FAILED"
            raise
        self.seconds, self.status = time.monotonic() - began, "COMPLETED"
        return table

    def notice(self) -> str:
        """What to tell the user of the way the query runs."""
        if self.problem:
            return self.problem
        told = {"each": "runs over each shard by itself, with the rows of each", "subset": "runs over what the active shards hold, put together", "shards": "runs over all shards together, exactly, from the whole tables", "whole": "runs over whole tables"}
        return told[self.mode] + (f": {'; '.join(self.reasons)}" if self.reasons else "")


def summarize(parts: DataFrame, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    """One row for each key from rows by shard.

    aggregates maps a column to sum, count, min, max or `avg:<sum column>:<count column>`;
    an average is worked out from its sums and counts, never from averages. Distinct counts
    can't be put together from counts by shard unless the shards share no value.
    """

    def merged(name: str, how: str) -> Column:
        if how.startswith("avg:"):
            _, total, n = how.split(":")
            return F.try_divide(F.sum(total), F.sum(n)).alias(name)
        return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[how](name).alias(name)

    return parts.groupBy(*keys).agg(*[merged(n, h) for n, h in aggregates.items()])


class Engine:
    """Runs SQL over the tables below root, and over shards of them where a path to built ones is given.

    With a user file, a token `name:password` that it knows is needed.
    """

    def __init__(self, spark: SparkSession, root: str, shards: str | None = None, settings: Settings | None = None, user_file: str | None = None, token: str = ""):
        self.user = authenticate(user_file, token) if user_file else None
        if user_file and self.user is None:
            raise PermissionError("the user or the password is wrong")
        self.spark, self.root = spark, root
        self.settings = settings or Settings()
        register_functions(spark)
        self.tables = register(spark, root)
        self.shards = Shards(spark, shards) if shards else None

    def active(self) -> list[int]:
        """The shards that queries by shard run over."""
        have = self.shards.numbers if self.shards else []
        return have if self.settings.active_shards is None else [n for n in have if n in self.settings.active_shards]

    def sql(self, text: str) -> QueryRun:
        """A run of one SELECT statement.

        Results are exact and over all rows, as Spark aggregates in two steps itself. With some
        shards active only, a query that may run by shard sees what those shards hold. With
        summarize off, or distributed FORCE, it returns the rows of each active shard, told
        apart by shard_number. The run's mode says which it was.
        """
        run = QueryRun(stripped(text))
        kind = classify(self.spark, run.text)
        if not kind.is_query:
            run.status, run.problem = "FAILED", kind.problem
            return run
        run.mode, run.reasons = plan_distribution(self.settings, kind.has_aggregates, len(self.active()))
        if run.mode == "shards" and (self.settings.distributed == "FORCE" or not self.settings.summarize):
            run.mode, run.df = "each", self.per_shard(run.text)
        elif run.mode == "shards" and self.active() != self.shards.numbers:
            run.mode, run.df = "subset", self.together(run.text)
        else:
            run.df = self.spark.sql(run.text)
        return run

    def _apart(self) -> SparkSession:
        """A session whose views no other user of this one sees, with the same settings of results."""
        session = self.spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
            session.conf.set(key, self.spark.conf.get(key))
        register_functions(session)
        return session

    def together(self, text: str) -> DataFrame:
        """A query over what the active shards hold, as one plan."""
        session = self._apart()
        whole = Tables(session, self.root)
        for name, df in Shards(session, self.shards.path).subset(lambda n: getattr(whole, n), self.active()).items():
            df.createOrReplaceTempView(name)
        return session.sql(text)

    def per_shard(self, text: str) -> DataFrame:
        """The rows of a query run over each active shard by itself, with shard_number."""
        session, parts = self._apart(), []
        shards = Shards(session, self.shards.path)
        for number in self.active():
            for name in shards.modes:
                shards.table(name, number).createOrReplaceTempView(name)
            parts.append(session.sql(stripped(text)).withColumn(SHARD, F.lit(number)))
        if not parts:
            raise ValueError("no shards are active")
        return reduce(DataFrame.unionByName, parts)

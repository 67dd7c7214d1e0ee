"""Named analytical queries and the classification of SQL text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from lakeweave.sources.catalog import Tables


class Entry(NamedTuple):
    """A query over the tables of a data set, and the same in DuckDB SQL where it can be said there."""

    run: Callable[[Tables], DataFrame]
    sql: str | None


class Registry(dict):
    """Entries by name; used as a decorator."""

    def __init__(self, prefix: str, preamble: str = ""):
        self.prefix, self.preamble = prefix, preamble

    def __call__(self, sql: str | None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self[f"{self.prefix}{f.__name__.lstrip('_')}"] = Entry(f, None if sql is None else self.preamble + sql)
            return f

        return add

"""Column functions that Spark spells differently."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Strftime directives and the Spark date patterns for them.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "y": "yy", "j": "DDD"}


def strftime(at: Column, pattern: str) -> Column:
    """A date or timestamp as text by a strftime pattern, through date_format."""
    out = ""
    for directive, literal in re.findall(r"%(.)|([^%]+)", pattern):
        if directive and directive not in _DIRECTIVES:
            raise ValueError(f"%{directive} has no Spark pattern")
        out += _DIRECTIVES[directive] if directive else re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", literal)
    return F.date_format(at, out)


def register_functions(spark: SparkSession) -> None:
    """Makes strftime a temporary SQL function: a date or timestamp and a pattern, in either order.

    The pattern may hold the directives above and characters that are no letters.
    """
    pattern = "if(contains(a, '%'), a, b)"
    for directive, letters in _DIRECTIVES.items():
        pattern = f"replace({pattern}, '%{directive}', '{letters}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strftime(a STRING, b STRING) RETURNS STRING RETURN date_format(CAST(if(contains(a, '%'), b, a) AS TIMESTAMP), {pattern})")


def day(text: str) -> Column:
    """A literal midnight without zone, which the Parquet reader can compare with its statistics."""
    return F.expr(f"TIMESTAMP_NTZ'{text} 00:00:00'")


def shard_of(key: Column, shards: int) -> Column:
    """Shard 1..shards of a key by hash; a null key goes where its hash goes."""
    return (F.pmod(F.xxhash64(key), F.lit(shards)) + 1).cast("int")


def shard_by_remainder(key: Column, shards: int) -> Column:
    """Shard 1..shards by remainder, for results that another engine has to repeat."""
    return (F.pmod(key, F.lit(shards)) + 1).cast("int")

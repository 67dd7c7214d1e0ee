"""Joins that a plain `join` does not say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """rows WHERE key NOT IN (the one column of listed), with SQL's rule for nulls.

    One null in the list leaves nothing, and a null key is kept only where the list is
    empty. Both are told by two counts, so the join itself stays an anti join on a key
    that may be shuffled, at any size of the list.
    """
    name = listed.columns[0]
    facts = listed.agg(F.count("*").alias("_listed"), F.count(name).alias("_known"))  # one row
    known = listed.where(F.col(name).isNotNull()).select(F.col(name).alias("_key"))
    kept = rows.join(known, F.col(key) == F.col("_key"), "left_anti")
    allowed = (F.col("_listed") == 0) | ((F.col("_listed") == F.col("_known")) & F.col(key).isNotNull())
    return kept.join(F.broadcast(facts), allowed).select(*rows.columns)


def range_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """points with all spans where low <= at < high, by an equi-join on buckets of the width.

    A span stands under every bucket that it touches, so a width near the usual length of a
    span keeps both the copies and the candidates few. Empty spans and nulls match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = spans.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_bucket", bucket(at)).join(spread, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")

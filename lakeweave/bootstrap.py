"""From a folder of tables to an engine with shards and a user, in one call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeweave.session import Engine
from lakeweave.sources.catalog import folders
from lakeweave.sources.shards import ORDERS_TREE, ShardTable, build_shards
from lakeweave.users import create_user


def bootstrap(spark: SparkSession, root: str, shard_path: str, shards: int = 11, tree: tuple[ShardTable, ...] = ORDERS_TREE, user: tuple[str, str] | None = None, user_file: str | None = None, overwrite: bool = False) -> Engine:
    """Builds the shards of the tables below root, makes the user if one is given, and returns the engine."""
    paths = folders(spark, root)
    build_shards(spark, lambda name: spark.read.parquet(paths[name]), tree, shards, shard_path, overwrite=overwrite)
    if user and user_file:
        create_user(user_file, *user)
    return Engine(spark, root, shard_path, user_file=user_file, token=":".join(user) if user else "")

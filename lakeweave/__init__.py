"""Spark-first SQL analytics over star-schema data, with shard datasets and a small session layer."""

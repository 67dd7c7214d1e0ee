"""Tables over files: lazily read, and registered as views."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders whose view has another name.
ALIASES = {"date": "date_dim"}
#: File endings and the reader for them; folders are Parquet unless said otherwise.
FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json"}


#: Schemas of files known by path, time of change and size, and how many are kept at most.
_KNOWN: dict[tuple[str, int, int], StructType] = {}
MOST_KNOWN = 1000


class Tables:
    """The tables of a data set as attributes: `<root>/<name>.parquet` or a folder `<root>/<name>`.

    Finding out a schema is a job of its own, so that of a single file is kept until the file
    changes; a folder is looked into once for each of these objects.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries = _listed(spark, self.root)
        self.own: dict[str, StructType] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.entries:
            raise AttributeError(f"{self.root} has no table {name}")
        path, *version = self.entries[name]
        kept, key = (_KNOWN, (path, *version)) if version else (self.own, path)
        rows = read(self.spark, path, schema=kept.get(key))
        if len(kept) >= MOST_KNOWN:
            kept.clear()
        kept[key] = rows.schema
        return rows


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | StructType | None = None) -> DataFrame:
    """A table from files of one format, by the ending of the path where none is given.

    Text formats need a schema: without one Spark would read all of the data just to guess it.
    """
    fmt = fmt or FORMATS.get(path.rstrip("/").rpartition(".")[2], "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "json") and not schema:
        raise ValueError(f"{fmt} needs a schema")
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def _listed(spark: SparkSession, root: str) -> dict[str, tuple]:
    """Table name and path of each entry below root, in any store that Spark's file systems reach; with time of change and size of files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = {}
    for status in listed:
        at, folder = status.getPath().toString(), status.isDirectory()
        name = at.rpartition("/")[2]
        if name[:1] not in "._" and (folder or name.rpartition(".")[2] in FORMATS):
            table = name.partition(".")[0]
            found[ALIASES.get(table, table)] = (at,) if folder else (at, status.getModificationTime(), status.getLen())
    return dict(sorted(found.items()))


def folders(spark: SparkSession, root: str) -> dict[str, str]:
    """Table name and path of each entry below root."""
    return {name: path for name, (path, *_) in _listed(spark, root).items()}


def register_arrow(spark: SparkSession, name: str, table: pa.Table) -> None:
    """Makes an Arrow table in memory a view; it goes to Spark whole, so it is for small tables."""
    spark.createDataFrame(table).createOrReplaceTempView(name)


def register(spark: SparkSession, root: str, materialize: bool = False, schemas: dict[str, str] | None = None) -> list[str]:
    """Makes each table below root a view, or with materialize a managed table; returns their names. schemas has those of tables in text formats."""
    names = []
    for name, path in folders(spark, root).items():
        df = read(spark, path, schema=(schemas or {}).get(name))
        if materialize:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)
        names.append(name)
    return names


def export(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Writes zstd Parquet; refuses to replace what is there unless overwrite is set."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

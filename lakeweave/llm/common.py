"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import lakeweave

#: The characters that end a word: space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\f\r"
#: The same as a regular expression for Java, Python and DuckDB.
BREAK_CLASS = r"[\x20\x09-\x0D]"
#: Neighbouring ids that are sampled together, and the most ranges of ids that a sample's filter lists.
BLOCK, MOST_BLOCKS = 16, 512
#: Bytes of an Arrow batch that goes to a Python worker, and Spark's setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched by exact name and position.

    Further columns are dropped first, so names that differ in case only or that
    clash with an operator's own names do no harm. The first of several columns
    of one name counts.
    """
    at = {n: df.columns.index(n) for n in names}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for n, i in at.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. In local mode a temporary folder will do where it is unset; a cluster must name one that all machines see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back, which ends the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def one_each(df: DataFrame, key: str, *by: str) -> DataFrame:
    """One row for each value of key, the same however the rows are dealt out: the first by the other columns named and a hash of all that can be hashed. Rows without a key stay."""
    hashed = [n for n, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*by, F.xxhash64(*hashed)))
    return df.withColumn("_first", first).where((F.col("_first") == 1) | F.col(key).isNull()).drop("_first")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo the number of folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """A sample of `most` rows, as expected from a hash of `key`; all rows when there are no more."""
    n = df.count()
    return df if n <= most else sampled(df, key, F.lit(most / n))


def sampled(df: DataFrame, key: str, share: Column, salt: int = 7) -> DataFrame:
    """The rows of df whose block of ids falls into the share (0 to 1) by its hash; share may differ by row.

    A block holds BLOCK neighbouring ids. Which blocks are wanted is told from the narrow
    columns alone, and their ranges are added as a filter: where files are in the order of
    the ids, the scan of the wide columns skips all other row groups instead of reading
    everything for a small sample. Ids that are no integers are hashed by themselves.
    """
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    block = F.floor(F.coalesce(F.col(key), F.lit(0)) / BLOCK) if whole else F.col(key)
    kept = df.where(F.pmod(F.xxhash64(block, F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30))
    if not whole:
        return kept
    blocks = sorted(r["block"] for r in kept.select(block.alias("block")).distinct().limit(MOST_BLOCKS + 1).collect())
    if not blocks or len(blocks) > MOST_BLOCKS:
        return kept
    tests = [F.col(key).between(b * BLOCK, (b + 1) * BLOCK - 1) for b in blocks] + [F.col(key).isNull()] * (0 in blocks)
    while len(tests) > 1:  # a balanced tree of ORs
        tests = [reduce(or_, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return kept.where(tests[0])


_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Sends this package to the Python workers, once for each application.

    Functions are sent to workers by name, so workers must be able to import them wherever
    the driver was started, also on machines that don't have the package.
    """
    if context.applicationId in _shipped:
        return
    package = Path(lakeweave.__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lakeweave-"))  # the driver serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/lakeweave_workers.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def arrow_map(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of a few megabytes.

    Texts differ in length by orders of magnitude, so batches are bounded by bytes and not
    by rows alone; a session that has set a bound of its own keeps it.
    """
    ship(rows.sparkSession.sparkContext)
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) in (None, "-1", str((1 << 31) - 1)):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def mapped(docs: DataFrame, change: Callable[[pa.RecordBatch, dict[str, int]], pa.RecordBatch]) -> DataFrame:
    """docs with each Arrow batch changed, all columns and their types kept.

    change gets a batch and the place of each column; names that clash do no harm, as the
    batch's own names are c0, c1 and so on.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: i for i, n in reversed(list(enumerate(docs.columns)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch, at)

    return arrow_map(plain, run, plain.schema).toDF(*docs.columns)

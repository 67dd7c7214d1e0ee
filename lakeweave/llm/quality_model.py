"""A quality classifier: boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import arrow_map, bounded, cut, fold, pick
from lakeweave.llm.quality_rules import STOP_WORDS
from lakeweave.llm.trees import Forest, fit_forest

#: Marks that have a statistic of their own.
MARKS = "#*$%&|!?.,;:\"'<>=-_/@"
_CODES = np.frombuffer(MARKS.encode(), np.uint8)
_STOP = frozenset(STOP_WORDS)


def statistics(text: str) -> list[float]:
    """Length, characters by class, words, repeats and lines of the whole text."""
    n = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(n.sum()))
    words = text.split()
    many = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    rows = max(1, len(lines))
    upper, lower = n[65:91].sum(), n[97:123].sum()
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(size),
        np.log1p(len(words)),
        upper / size,
        upper / max(1, upper + lower),
        n[48:58].sum() / size,
        n[128:].sum() / size,
        (size - n[128:].sum()) / many,
        len(set(words)) / many,
        pairs / max(1, len(words) - 1),
        sum(w in _STOP for w in words) / many,
        rows,
        len(set(lines)) / rows,
        many / rows,
        max(map(len, words), default=0),
        *(n[_CODES] / many),
    ]


WIDTH = len(statistics(""))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (array<double>) of each row of docs (doc_id, text); a null text counts as empty."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))})

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, most_labelled: int = 20_000) -> DataFrame:
    """The quality of each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Returns doc_id, held_out, score and predicted (score >= threshold). Only labelled rows
    whose fold of the id is not held out are learnt from, about most_labelled of them by hash
    of the id where there are more; rows without a label are not. Without usable labels the
    score is one half. Of repeated labels the largest counts. Null and empty texts get the
    score of their statistics. The statistics of all documents are computed once and
    written, and both the fit and the scores read those. Further columns are ignored.
    """
    stats = cut(document_statistics(docs))
    usable = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    usable = bounded(usable.where(fold(F.col("doc_id"), folds) != held_out), "doc_id", most_labelled)
    known = stats.join(usable, "doc_id").select("x", F.col("y").cast("int").alias("y"), "doc_id").limit(2 * most_labelled).toPandas().sort_values(["doc_id", "y"])
    x = np.stack(known["x"].to_numpy()) if len(known) else np.zeros((0, WIDTH))
    shared = stats.sparkSession.sparkContext.broadcast(fit_forest(x, known["y"].to_numpy(float)))
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            score = forest.score(flat)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return arrow_map(stats.select("doc_id", "x", (fold(F.col("doc_id"), folds) == held_out).alias("held_out")), run, f"doc_id {id_type}, held_out boolean, score double, predicted int")

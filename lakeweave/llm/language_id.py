"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier for each bit, a logistic
regression over hashed byte trigrams, predicts that bit. Decoding weighs the logistic
loss of each bit and takes the nearest codeword; a close second flags the text as
ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import arrow_map, fold, mapped, pick, sampled

#: Hash buckets of the trigrams.
BUCKETS = 1 << 13
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes to bytes: ASCII that is no letter becomes a space.
_PLAIN = np.array([b if b > 127 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


class Model(NamedTuple):
    languages: list[str]
    codewords: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    offsets: np.ndarray  # bits
    bit_weights: np.ndarray  # how much each bit's loss counts


def counts(text: str) -> np.ndarray:
    """Square roots of the trigram counts of the whole text, of length one."""
    b = _PLAIN[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    if len(b) > 1:
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    b = np.concatenate((np.array([32], np.uint32), b, np.array([32], np.uint32)))
    if len(b) < 3:
        return np.zeros(BUCKETS, np.float32)
    grams = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)
    x = np.sqrt(np.bincount(grams, minlength=BUCKETS).astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n codewords of -1 and 1: all splits up to five languages, else random ones with the best least distance of 200 tries."""
    if n <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and -1 in s] or [(1,) * n]
        return np.array(splits, np.float32).T
    bits = math.ceil(10 * math.log2(n))
    rng = np.random.default_rng(seed)
    tries = (np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.float32) for _ in range(200))
    usable = [c for c in tries if (np.abs(c.sum(0)) < n).all()]
    return max(usable, key=lambda c: ((bits - c @ c.T) / 2 + np.eye(n) * bits).min())


def fit(samples: list[tuple[str, np.ndarray]], steps: int = 150, decay: float = 1e-4) -> Model:
    """All bits at once by gradient descent with momentum; a bit's weight falls with its error on the samples."""
    languages = sorted({lang for lang, _ in samples})
    code = codewords(len(languages)) if languages else np.zeros((0, 1), np.float32)
    bits = code.shape[1]
    w, c = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) < 2:
        return Model(languages, code, w, c + 1, np.ones(bits, np.float32))
    at = np.array([languages.index(lang) for lang, _ in samples])
    x, y = np.stack([f for _, f in samples]), code[at]
    share = 1 / np.bincount(at, minlength=len(languages))[at]
    share = (share / share.sum()).astype(np.float32)[:, None]
    vw, vc, rate = np.zeros_like(w), np.zeros_like(c), 20.0
    for _ in range(steps):
        pull = share * y / (1 + np.exp(np.clip(y * (x @ w + c), -30, 30)))
        vw = 0.9 * vw + rate * (x.T @ pull - decay * w)
        vc = 0.9 * vc + rate * 0.1 * pull.sum(0)
        w, c = w + vw * 0.1, c + vc * 0.1
    wrong = (share * (np.sign(x @ w + c) != y)).sum(0)
    return Model(languages, code, w, c, np.maximum(0.05, 1 - 2 * wrong).astype(np.float32))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of margins: the place of the nearest codeword, its share, and its lead over the second."""
    losses = (model.bit_weights * np.log1p(np.exp(-np.clip(margins[:, None, :] * model.codewords, -30, 30)))).sum(2)
    near = np.exp(losses.min(1, keepdims=True) - losses)
    near /= near.sum(1, keepdims=True)
    best = near.argmax(1)
    top = near[np.arange(len(near)), best]
    second = np.sort(near, 1)[:, -2] if near.shape[1] > 1 else np.zeros(len(near))
    return best, top, top - second


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and lead of each text; `und`, 0 and 1 for null texts and those without a letter."""
    n = len(texts)
    margins, known = np.zeros((n, len(model.offsets)), np.float32), np.zeros(n, bool)
    for i, scalar in enumerate(texts):
        text = scalar.as_py()
        if text and model.languages and _LETTER.search(text):
            margins[i], known[i] = counts(text) @ model.weights + model.offsets, True
    lang, score, lead = np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n)
    if known.any():
        best, score[known], lead[known] = decode(model, margins[known])
        lang[known] = np.array(model.languages, object)[best]
    return lang, score, lead


def learn(docs: DataFrame, usable: Column, most: int = 400, most_languages: int = 500) -> Model:
    """Fits on the rows of docs (doc_id, text, lang) where usable holds and lang is not null.

    Of each language at most `most` rows are used (about as many by hash of the id, all
    of a smaller language), of the most_languages most frequent ones; only their trigram
    counts go to the driver.
    """
    rows = docs.where(usable & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes:
        return fit([])
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    chosen = sampled(rows, "doc_id", share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                x = counts(text.as_py() or "")
                at = np.flatnonzero(x)
                packed.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "x": pa.array(packed, pa.binary())})

    def unpacked(b: bytes) -> np.ndarray:
        x, n = np.zeros(BUCKETS, np.float32), len(b) // 6
        x[np.frombuffer(b[: 2 * n], "<u2")] = np.frombuffer(b[2 * n :], "<f4")
        return x

    kept: dict[str, list[np.ndarray]] = {}
    for r in arrow_map(chosen.select("text", "lang"), run, "lang string, x binary").limit(2 * most * len(sizes)).collect():
        if len(kept.setdefault(r["lang"], [])) < most:
            kept[r["lang"]].append(unpacked(bytes(r["x"])))
    return fit([(lang, x) for lang, found in sorted(kept.items()) for x in found])


def identify(docs: DataFrame, model: Model | None = None, folds: int = 4, held_out: int = 2, least_lead: float = 0.05) -> DataFrame:
    """The language of each row of docs (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred, score (share of the nearest codeword, 0 to 1) and
    ambiguous (lead over the second below least_lead). Without a model one is fitted on the
    rows whose fold of the id is not held out. Null texts and texts without a letter give
    `und` with score 0, not ambiguous; with no learnt language every text does. Each input
    row gives one row; equal texts give equal results; further columns are ignored.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    out = fold(F.col("doc_id"), folds) == held_out
    model = model or learn(rows, ~out)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, lead = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(lead < least_lead)})

    return arrow_map(rows.select("doc_id", "text", out.alias("held_out")), run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, folds: int = 4, held_out: int = 2, least_lead: float = 0.05) -> DataFrame:
    """The rows of docs, all columns, whose language identify() finds and doesn't call ambiguous; nothing is shuffled."""
    if model is None:
        rows = pick(docs, "doc_id", "text", "lang")
        model = learn(rows, fold(F.col("doc_id"), folds) != held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def change(batch: pa.RecordBatch, at: dict[str, int]) -> pa.RecordBatch:
        lang, _, lead = predict(shared.value, batch.column(at["text"]))
        return batch.filter(pa.array((lang != UNDETERMINED) & (lead >= least_lead)))

    return mapped(docs, change)

"""Byte-level BPE: encoding by a rank table and decoding by concatenation of its pieces.

The texts stay in their partitions. Each task keeps a bounded dictionary from the
pieces it has met to their ids, so the ranked merges run about once for each distinct
piece; the rank table (fixed size) is a broadcast variable.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeweave.llm.common import arrow_map, pick

#: Most distinct pieces that one Python worker remembers; others are merged anew.
REMEMBERED = 600_000
#: Longer pieces (bytes) use a heap instead of a scan for the next merge.
SCANNED = 96


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none has a rank."""
    if (known := ranks.get(piece)) is not None:
        return [known]
    if len(piece) > SCANNED:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks) + 1
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), in n log n steps: a heap of (rank, place) over a linked list of parts."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, both))

    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in parts if p is not None]


class Codec(dict):
    """Packed ids (little-endian, 32 bits) of each piece, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(self) < REMEMBERED:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The worker's codec for a table; workers live on from task to task."""
    key = (len(ranks), pattern, hash(frozenset(ranks.items())))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes the text of each row of docs (doc_id, text).

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, and with with_ids also
    ids (array<long>) and decoded (string). A null text counts as empty: no ids, and
    the digests of nothing. Each input row gives one row; further columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    table = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(table.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha, ids_all, texts = [], [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_all.append(np.frombuffer(ids, "<u4").astype("int64"))
                    texts.append(decoded.decode("utf-8", "replace"))
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(ids_all, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<bigint>, decoded string" if with_ids else ""
    return arrow_map(rows, run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")

"""Near-dedup by SimHash with an exact check, and an exact way for the copies that lie further apart.

SimHash groups (simhash.py: byte-position inverted index, count filtering, two differing
bits) come first, and the exact check confirms their links. Near copies that differ in
more bits are found by prefix filtering on the rarest shingles and the same check, which
leaves out the pairs that SimHash's links connect already.

Two documents are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. All shingles have one order, rare ones first. Of n shingles a
near copy shares at least 0.8 n, so two near copies have a shingle in common among the
first n - ceil(0.8 n) + 1 of each: indexing those finds every pair. Pairs are dropped where
their sizes, or what stands before their first common shingle, exclude the similarity; the
rest are compared exactly. The order decides the
cost only: shingles that many of all documents have come last, by how many.

Documents with the same words are one node from the start, and postings with the same
members are one. Members of a crowded posting are first compared with one leader, the one
with the least before the shingle; then
all its members that no link has connected yet are compared with each other, those of
small groups with all others, so that the groups are those of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from lakeweave.llm.common import arrow_map, cut, one_each, pick
from lakeweave.llm.components import connected_components
from lakeweave.llm.simhash import LOWER, near_duplicates

#: Members of a posting up to which all are paired at once; larger ones have a leader first.
PAIRED = 8
#: Documents that a frequent shingle is in at least, and how many of the most frequent are listed at most (12 bytes each).
FREQUENT, LISTED = PAIRED + 1, 2_000_000
#: Documents whose shingles are counted together, about, shingles that a worker gathers before it sends them on, and bits of a shingle that are sent.
COUNTED, GATHERED, SENT = 2048, 1 << 20, 32
#: Rows of a batch that a worker returns, about.
ROWS = 50_000
#: Ids up to which a list of candidates is broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, one without words has none.

    Each word is hashed once; a shingle's hash is the sum of its words' hashes, each times
    an odd number for its place, with the bits mixed.
    """
    found = _words(text)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found))] if found else [], np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += each[k : k + n] * np.uint64(xxh3_64_intdigest(b"place", k) | 1)
    total ^= total >> np.uint64(31)
    total *= np.uint64(xxh3_64_intdigest(b"mixed") | 1)
    return np.unique(total ^ total >> np.uint64(29))


def prefix(found: np.ndarray, listed: Frequent, least: float) -> np.ndarray:
    """The first of a document's shingles in the common order, as many as a near copy can't avoid."""
    n = len(found)
    if n == 0:
        return found
    taken = n - ceil(least * n - 1e-9) + 1
    if len(listed.heads):
        heads = found >> np.uint64(64 - listed.bits)
        at = np.minimum(np.searchsorted(listed.heads, heads), len(listed.heads) - 1)
        found = found[np.lexsort((found, np.where(listed.heads[at] == heads, listed.times[at], 0)))]
    return found[:taken]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and same (a hash of the word sequence) of each row of docs (doc_id, text) that has a doc_id."""
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.array([_same(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "same": pa.array(same.view(np.int64))})

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint")


def _same(text: str | None) -> int:
    return xxh3_64_intdigest(b" ".join(_words(text or "")))


class Frequent(NamedTuple):
    """The leading bits of shingles that many documents have, sorted, and how many have each."""

    bits: int
    heads: np.ndarray
    times: np.ndarray


def frequent(docs: DataFrame, n_docs: int, words: int = 5, most: int = LISTED) -> Frequent:
    """The most frequent shingles of all docs, at most so many; n_docs (about) sets how finely the counting is dealt out.

    Shingles go by their leading bits to slices of about COUNTED documents' worth each, so
    that a slice stays the same size whatever the table's. Workers send sorted runs of
    32-bit numbers. A shingle under the count that `most` leaves room for is not
    listed, which costs comparisons later and changes no result.
    """
    first = min(24, max(4, (n_docs // COUNTED).bit_length()))
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for text in batch.column("text"):
                gathered.append(shingles(text.as_py() or "", words) >> np.uint64(64 - first - SENT))
                held += len(gathered[-1])
                if held >= GATHERED:
                    yield runs(gathered)
                    gathered, held = [], 0
        if held:
            yield runs(gathered)

    def runs(gathered: list[np.ndarray]) -> pa.RecordBatch:
        heads = np.sort(np.concatenate(gathered))
        place, low = (heads >> np.uint64(SENT)).astype(np.int32), heads.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(cuts[1:], len(place))
        return pa.RecordBatch.from_pydict({"slice": pa.array(place[cuts]), "run": pa.array([low[i:j].tobytes() for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, run in zip(batch.column("slice").to_pylist(), batch.column("run"), strict=True):
                by.setdefault(k, []).append(np.frombuffer(run.as_buffer(), np.uint32))
        for k in sorted(by):
            low, times = np.unique(np.concatenate(by.pop(k)), return_counts=True)
            many = times >= FREQUENT
            yield pa.RecordBatch.from_pydict({"head": pa.array((low[many].astype(np.int64)) | (k << SENT)), "times": pa.array(times[many].astype(np.int32))})

    each = cut(arrow_map(arrow_map(rows, sliced, "slice int, run binary").repartition("slice"), counted, "head bigint, times int"))
    grade = F.floor(F.log2("times") * 8).cast("int")
    room, lowest = most, 1 << 30
    for r in sorted(each.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        lowest = r["grade"]
    chosen = each.where(grade >= lowest).toArrow()
    heads, times = chosen["head"].to_numpy().view(np.uint64), chosen["times"].to_numpy()
    order = np.argsort(heads)
    return Frequent(first + SENT, heads[order], times[order])


def postings(docs: DataFrame, listed: Frequent, words: int = 5, least: float = 0.8) -> DataFrame:
    """The distinct sets of two or more members that share a shingle of their prefixes: id, m (same of each, sorted), z (its number of shingles) and w (those not before the first shared one)."""
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, same, sizes, left = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py() or "", words)
                first = prefix(found, shared.value, least)
                keys.append(first.view(np.int64))
                same.append(np.full(len(first), _same(text.as_py()), np.uint64).view(np.int64))
                sizes.append(np.full(len(first), len(found), np.int32))
                left.append(len(found) - np.arange(len(first), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "same": np.concatenate(same), "z": np.concatenate(sizes), "w": np.concatenate(left)})

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("key", "same", "z", "w")] for batch in batches]
        if not parts:
            return
        key, same, z, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((same, key))
        key, same, z, w = key[order], same[order], z[order], w[order]
        new = np.append(True, (key[1:] != key[:-1]) | (same[1:] != same[:-1]))
        key, same, z, w = key[new], same[new], z[new], w[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        several, sets = ends - starts > 1, {}
        for i, j in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            put(sets, xxh3_128_digest(same[i:j].tobytes()), same[i:j], z[i:j], w[i:j])
        yield from batches_of(sets)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {}
        for batch in batches:
            for row in range(batch.num_rows):
                put(sets, batch.column("id")[row].as_py(), *(batch.column(c)[row].values.to_numpy() for c in ("m", "z", "w")))
        yield from batches_of(sets)

    def put(sets: dict, name: bytes, m: np.ndarray, z: np.ndarray, w: np.ndarray) -> None:
        sets[name] = (m, z, np.maximum(w, sets[name][2]) if name in sets else w)

    def batches_of(sets: dict) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for name, (m, z, w) in sets.items():
            out.append((name, m, z, w))
            held += len(m)
            if held >= ROWS:
                yield batch_of(out)
                out, held = [], 0
        yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        types = {"id": pa.binary(), "m": pa.list_(pa.int64()), "z": pa.list_(pa.int32()), "w": pa.list_(pa.int32())}
        return pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(types.items())})

    index = arrow_map(rows, indexed, "key bigint, same bigint, z int, w int").repartition("key")
    schema = "id binary, m array<bigint>, z array<int>, w array<int>"
    return arrow_map(arrow_map(index, grouped, schema).repartition("id"), merged, schema)


def _pairs(sets: DataFrame, least: float, paired: int | None) -> DataFrame:
    """Distinct pairs (x, y) of members of the sets (m, z, w, g) that may have the similarity.

    With paired, all pairs of sets of up to so many members, and those with a leader of
    larger sets; without it all pairs of members of different groups g.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, held = [], [], 0
            for row in range(batch.num_rows):
                m, z, w, g = (batch.column(c)[row].values.to_numpy() for c in ("m", "z", "w", "g"))
                if paired is None:
                    # members of the largest group meet only the others
                    kinds, at, counts = np.unique(g, return_inverse=True, return_counts=True)
                    order = np.argsort(at == counts.argmax(), kind="stable")
                    m, z, w, g = m[order], z[order], w[order], at[order]
                    first = len(m) - int(counts.max())
                elif len(m) <= paired:
                    first = len(m) - 1
                else:
                    order = np.lexsort((m, -w / z))
                    m, z, w, first = m[order], z[order], w[order], 1
                for i in range(first):
                    fit = np.minimum(z[i], z[i + 1 :]) >= least * np.maximum(z[i], z[i + 1 :]) - 1e-9
                    fit &= np.minimum(w[i], w[i + 1 :]) >= least / (1 + least) * (z[i] + z[i + 1 :]) - 1e-9
                    if paired is None:
                        fit &= g[i + 1 :] != g[i]
                    other = m[i + 1 :][fit]
                    xs.append(np.minimum(m[i], other))
                    ys.append(np.maximum(m[i], other))
                    held += len(other)
                    if held >= ROWS:
                        yield distinct(xs, ys)
                        xs, ys, held = [], [], 0
            if held:
                yield distinct(xs, ys)

    def distinct(xs: list, ys: list) -> pa.RecordBatch:
        both = np.unique(np.stack((np.concatenate(xs), np.concatenate(ys)), axis=1), axis=0)
        return pa.RecordBatch.from_pydict({"x": both[:, 0].copy(), "y": both[:, 1].copy()})

    return arrow_map(sets.select("m", "z", "w", "g"), run, "x bigint, y bigint").distinct()


def bits(found: np.ndarray) -> bytes:
    """The number of shingles, and a bitmap of two to four bits for each by the low bits of its hash."""
    marked = np.zeros(1 << max(6, (2 * len(found)).bit_length()), bool)
    marked[(found & np.uint64(len(marked) - 1)).astype(np.int64)] = True
    return np.uint32(len(found)).tobytes() + np.packbits(marked).tobytes()


def may_be_near(x: bytes, y: bytes, least: float) -> bool:
    """Whether bits() of two documents leave the similarity open: a bit that only one has is a shingle that the other lacks."""
    n, p = int(np.frombuffer(x, np.uint32, 1)[0]), np.frombuffer(x, np.uint8, offset=4)
    m, q = int(np.frombuffer(y, np.uint32, 1)[0]), np.frombuffer(y, np.uint8, offset=4)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    common = min(n - int(np.unpackbits(p & ~q).sum()), m - int(np.unpackbits(q & ~p).sum()))
    return common >= least * (n + m - common) - 1e-9


def are_near(x: bytes, y: bytes, least: float) -> bool:
    """Whether two sets of shingles have the similarity."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common >= least * (len(p) + len(q) - common)


def _told(docs: DataFrame, ids: DataFrame, tell: Callable[[np.ndarray], bytes], words: int, unique: bool) -> DataFrame:
    """doc_id and s, what tell makes of the shingles, of the documents with the ids (doc_id)."""
    listed = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = pick(docs, "doc_id", "text").join(listed, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "s": pa.array([tell(shingles(t.as_py() or "", words)) for t in batch.column("text")], pa.binary())})

    made = arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, s binary")
    return cut(made if unique else made.groupBy("doc_id").agg(F.min("s").alias("s")))


def _passing(pairs: DataFrame, told: DataFrame, test: Callable[[bytes, bytes, float], bool], least: float) -> DataFrame:
    """Those of the pairs (a, b) whose s pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [test(x.as_buffer(), y.as_buffer(), least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sided = pairs.join(told.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(told.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    id_type = dict(pairs.dtypes)["a"]
    return cut(arrow_map(sided.select("a", "b", "x", "y"), run, f"a {id_type}, b {id_type}"))


def verified(docs: DataFrame, pairs: DataFrame, words: int = 5, least: float = 0.8, unique: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose texts have the similarity; unique if no doc_id has two rows.

    Bitmaps settle most pairs that lack it, so whole sets are made and moved for the others only.
    """
    ids = lambda some: cut(some.select(F.col("a").alias("doc_id")).unionByName(some.select(F.col("b").alias("doc_id"))).distinct())
    left = pairs if not unique else _passing(pairs, _told(docs, ids(pairs), bits, words, unique), may_be_near, least)
    return _passing(left, _told(docs, ids(left), np.ndarray.tobytes, words, unique), are_near, least)


def hashed_links(docs: DataFrame, nodes: DataFrame, words: int = 5, least: float = 0.8, unique: bool = False) -> DataFrame:
    """Links (a, b) from the least node of each SimHash group to those of its other nodes (node, same) that have the similarity to it."""
    grouped = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return verified(docs, cut(grouped.join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct()), words, least, unique)


def _unconnected(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose nodes are not of one group (node, component)."""
    side = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"{k}_group"))
    told = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return told.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")


def near_links(docs: DataFrame, nodes: DataFrame, words: int = 5, least: float = 0.8, paired: int = PAIRED, unique: bool = False) -> DataFrame:
    """Links (a, b) between nodes (node, same) that connect what all pairs of the similarity connect: those of SimHash groups first, then the rest."""
    hashed = hashed_links(docs, nodes, words, least, unique)
    grouped = cut(connected_components(hashed))
    sets = cut(postings(docs, frequent(docs, nodes.count(), words), words, least))
    named = lambda pairs: pairs.join(nodes.select(F.col("same").alias("x"), F.col("node").alias("a")), "x").join(nodes.select(F.col("same").alias("y"), F.col("node").alias("b")), "y").select("a", "b")
    first = cut(_pairs(sets.withColumn("g", F.col("m")), least, paired))
    found = hashed.unionByName(verified(docs, cut(_unconnected(named(first), grouped)), words, least, unique))
    members = sets.where(F.size("m") > paired).select("id", F.explode(F.arrays_zip("m", "z", "w")).alias("r")).select("id", F.col("r.m").alias("same"), "r.z", "r.w")
    if members.isEmpty():
        return found
    groups = nodes.join(connected_components(found), "node").groupBy("same").agg(F.min(F.xxhash64("component")).alias("g"))
    told = members.join(groups, "same", "left").withColumn("g", F.coalesce("g", F.xxhash64("same", F.lit(1))))
    open_sets = told.groupBy("id").agg(F.collect_list(F.struct("same", "z", "w", "g")).alias("r"), F.min("g").alias("low"), F.max("g").alias("high")).where("low < high")
    rest = _pairs(open_sets.select(F.col("r.same").alias("m"), "r.z", "r.w", "r.g"), least, None)
    return found.unionByName(verified(docs, cut(named(rest.join(first, ["x", "y"], "left_anti"))), words, least, unique))


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, paired: int = PAIRED) -> DataFrame:
    """The rows of docs, all columns, but of each group of near copies only the one with the smallest doc_id.

    A group is what links of the similarity, and equal word sequences, connect. Texts
    without words, null ones too, are equal. Rows of one doc_id are one document, of which
    one row stays; rows without a doc_id stay. An empty table gives an empty result.
    """
    signed = cut(signatures(docs))
    repeated = not signed.groupBy("doc_id").count().where("count > 1").isEmpty()
    nodes = cut(signed.groupBy("same").agg(F.min("doc_id").alias("node")))
    copies = signed.join(nodes, "same").where(F.col("doc_id") != F.col("node")).select("doc_id")
    groups = connected_components(near_links(docs, nodes, words, least, paired, not repeated))
    dropped = copies.unionByName(groups.where(F.col("node") != F.col("component")).select(F.col("node").alias("doc_id")))

    places = [f"c{i}" for i in range(len(docs.columns))]
    plain, key = docs.toDF(*places), places[docs.columns.index("doc_id")]
    kept = plain.join(cut(dropped.distinct()).select(F.col("doc_id").alias(key)), key, "left_anti")
    if repeated:
        there = kept.where(F.col(key).isNotNull())
        kept = one_each(there, key, places[docs.columns.index("text")]).unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*places).toDF(*docs.columns)

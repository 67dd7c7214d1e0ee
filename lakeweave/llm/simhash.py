"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most two bits share at least six of their
eight bytes, whatever the bits. The index holds each distinct fingerprint under 14
postings of four positional bytes each: the sets of four of the positions 0 to 7 whose
exclusive or is zero. Any six positions hold three of these sets, any five hold one at
most. So the number of postings that a pair shares tallies its shared positional bytes:
pairs with fewer than three share five bytes or fewer and are dropped, and the rest are
verified on the bits.

Postings with many members are not paired: their members are indexed under themselves
and their 64 one-bit variants instead. Two fingerprints share such a key exactly if they
differ in at most two bits, and no key can have more than 65 distinct members, so the
links found stay the same and grow with the members only. A pair that shares any such
posting is found there; a pair that shares none has its whole tally from the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeweave.llm.common import arrow_map, cut, pick
from lakeweave.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits in which linked fingerprints may differ.
MOST_BITS = 2
#: Byte positions of each posting, and how many postings two fingerprints with six equal bytes share at least.
POSTINGS = tuple(p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0)
LEAST_SHARED = 3
#: Members of a posting up to which they are paired.
PAIRED = 48


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of the text's word shingles, as an unsigned number.

    A-Z is lower-cased; words are runs without space or U+0009 to U+000D. A bit is 1 if
    it is set in over half of the shingles' XXH64, repeats counted. Fewer words make one
    shingle, none the fingerprint zero.
    """
    # bytes.split() takes exactly these six characters as breaks
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        return xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = len(found) - words + 1
    cuts = map(slice, (ends - sizes)[:n].tolist(), ends[words - 1 :].tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), np.uint64, n)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of docs (doc_id, text); a null text counts as empty."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(text.as_py() or "", words) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _posting(slot: int) -> Column:
    """The posting's number and its four bytes, in one long."""
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))
    key = F.lit(slot).cast("long")
    for k in POSTINGS[slot]:
        key = F.shiftleft(key, 8).bitwiseOR(byte(k))
    return key


def links(nodes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that join all nodes (node, fp: distinct fingerprints) at two differing bits or fewer."""
    postings = nodes.select("node", "fp", F.explode(F.array(*map(_posting, range(len(POSTINGS))))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = cut(postings.join(sizes, "key"))

    few = postings.where(F.col("n") <= paired).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "fp"))).alias("m"))
    first = few.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    tallied = first.groupBy("x", "y").agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    close = tallied.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MOST_BITS).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    variants = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    many = postings.where(F.col("n") > paired).select("node", "fp").distinct().select("node", F.explode(variants).alias("key"))
    stars = many.groupBy("key").agg(F.min("node").alias("a"), F.collect_set("node").alias("b")).where(F.size("b") > 1)
    return close.unionByName(stars.select("a", F.explode("b").alias("b")).where("a != b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, paired: int = PAIRED) -> DataFrame:
    """Fingerprint and component of each row of docs (doc_id, text).

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    reachable over links of two differing bits or fewer. Equal fingerprints, zero too, are
    one node with their smallest doc_id. Null and empty texts have fingerprint zero. A null
    doc_id is never smallest unless its group has no other, and then has a null component.
    Each input row gives one row; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, words))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).where(F.col("node").isNotNull()))
    found = connected_components(links(nodes, paired))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(roots, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

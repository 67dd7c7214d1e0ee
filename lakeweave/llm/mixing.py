"""Mixing sources to target weights by proportionate-fair scheduling.

Every source is cut into blocks. Block j of a source of weight w may start at slot
floor(j / w) and is due at ceil((j + 1) / w); the earliest deadline among the released
blocks takes each slot. Each source then stays within one block of its share at all times.

Weights are taken as they are, as whole numbers in the same proportion, so nothing is
rounded. One worker deals the slots from the table of sources, keeps one entry for each
source and writes a row for each block; each row of the data finds its block from its rank.
Blocks grow with the table beyond MOST_BLOCKS of them, so that worker's part does not.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import floor, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import arrow_map, cut, pick

#: Rows of a block, blocks of all sources at most (larger tables have larger blocks), and blocks of the plan in a batch.
BLOCK_ROWS, MOST_BLOCKS, BATCH = 16, 4_000_000, 50_000
#: Ids that are ranked together, about, and the parts that a source is dealt to at least.
RANKED, LEAST_PARTS = 4096, 256


def slots(shares: dict[str, float], cycle: int) -> dict[str, int]:
    """Whole slots of a cycle for each source, in proportion to its share (largest remainders), at least one each."""
    total = sum(shares.values())
    spare = cycle - len(shares)
    exact = {s: spare * w / total for s, w in shares.items()}
    out = {s: 1 + floor(x) for s, x in exact.items()}
    for s in sorted(shares, key=lambda s: (floor(exact[s]) - exact[s], s))[: cycle - sum(out.values())]:
        out[s] += 1
    return out


def whole(shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the shares."""
    exact = {s: Fraction(w) for s, w in shares.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(each: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) for each slot, in proportion to each, until the next source has no block left.

    The window of a block is its release to its deadline, in whole numbers. Of released
    blocks the earliest deadline goes first; of equal ones the block whose window overlaps
    the next one's, then the heavier source, then the name.
    """
    cycle = sum(each.values())
    waiting = [(0, s, 0) for s in sorted(each) if each[s]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    t = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            due = -(-(j + 1) * cycle // each[s])
            overlaps = (j + 1) * cycle % each[s] != 0
            heapq.heappush(ready, (due, not overlaps, -each[s], s, j))
        due, _, _, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        if j == blocks[s]:
            return
        yield s, j
        heapq.heappush(waiting, ((j + 1) * cycle // each[s], s, j + 1))
        t += 1


def pfair_cycle(each: dict[str, int]) -> list[tuple[str, int]]:
    """schedule() over one cycle; each gives every source's slots, which add up to the cycle."""
    return list(schedule(each, each))


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, source) with rank, from 0 in each source, in an order by hash of the id.

    Ids are dealt to buckets by hash; a source's rank is the size of its earlier buckets plus
    the place within the bucket, so that no source is sorted in one task.
    """
    buckets = max(LEAST_PARTS, total // RANKED)
    dealt = rows.withColumn("order", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sizes = dealt.groupBy("source", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("bucket")) - F.col("count"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id")))
    return within.join(before.select("source", "bucket", "before"), ["source", "bucket"]).select("doc_id", "source", (F.col("before") + F.col("place") - 1).alias("rank"))


def _plan(sizes: DataFrame, given: dict[str, float], power: float, block_rows: int, cycle: int | None) -> DataFrame:
    """source, block, phase and slot of each block of the sources (source, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {s: n for batch in batches for s, n in zip(batch.column("source").to_pylist(), batch.column("count").to_pylist(), strict=True)}
        if not counts:
            return
        blocks = {s: -(-n // block_rows) for s, n in counts.items()}
        mean = sum(given.values()) / len(given) if given else 1.0
        target = {s: given.get(s, mean) if given else n**power for s, n in counts.items()}
        each = slots(target, max(cycle, 2 * len(target))) if cycle else whole(target)
        used, out, at = dict.fromkeys(counts, 0), [], 0
        for s, j in schedule(each, blocks):
            out.append((s, j, "target", at))
            used[s], at = j + 1, at + 1
            if len(out) == BATCH:
                yield batch_of(out)
                out = []
        left = {s: n - used[s] for s, n in blocks.items() if n > used[s]}
        for s, j in schedule(left, left):
            out.append((s, used[s] + j, "rest", at))
            at += 1
            if len(out) == BATCH:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = {"source": pa.string(), "block": pa.int64(), "phase": pa.string(), "slot": pa.int64()}
        return pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(types.items())})

    return arrow_map(sizes.select("source", "count").repartition(1), run, "source string, block bigint, phase string, slot bigint")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, cycle: int | None = None) -> DataFrame:
    """The place of each row of docs (doc_id, source) in the mix.

    Returns doc_id, source, block (of its source, from 0), in_block, phase, slot and
    position (slot and in_block in one number: the order of the mix). weights gives target
    weights by source; without it they follow the sources' sizes to the given power, and
    sources that it lacks get the mean weight. Phase `target` keeps to the weights until the
    first source has no block left; what then remains follows in phase `rest`, interleaved
    in proportion to the blocks left, so that no row is lost. A null source is a source of
    its own. A block has block_rows rows, or so many more that there are about MOST_BLOCKS at
    most. In each phase a source is less than a block away from its share. With a cycle,
    weights are rounded to whole slots of so many first, at least one for each source. Each
    input row gives one row; rows of one id lie side by side; an empty table gives an empty
    result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = pick(docs, "doc_id", "source").select("doc_id", key.alias("source"))
    sizes = cut(rows.groupBy("source").count())
    given = {f"={s}" if s is not None else "": w for s, w in (weights or {}).items()}
    total = sizes.agg(F.sum("count")).first()[0] or 0
    block_rows = max(block_rows, -(-total // MOST_BLOCKS))
    plan = cut(_plan(sizes, given, power, block_rows, cycle))
    ranked = _ranked(rows, total)
    block = ranked.select("doc_id", "source", F.expr(f"rank div {block_rows}").alias("block"), (F.col("rank") % block_rows).alias("in_block"))
    out = block.join(plan, ["source", "block"])
    name: Column = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
    return out.select("doc_id", name.alias("source"), "block", "in_block", "phase", "slot", (F.col("slot") * block_rows + F.col("in_block")).alias("position"))


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """All rows of docs, all columns, in the order of the mix (sorted over partitions); rows without a doc_id come last."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, key = docs.toDF(*names), names[docs.columns.index("doc_id")]
    places = mix_sources(docs, weights, power).groupBy(F.col("doc_id").alias(key)).agg(F.min("position").alias("position"))
    return plain.join(cut(places), key, "left").orderBy(F.col("position").asc_nulls_last(), key).select(*names).toDF(*docs.columns)

"""Byte-level BPE of distinct words by Spark's higher-order functions alone.

The merges of a word are folded over its array of byte pieces; the rank table is a literal
array of small maps, as a lookup in a map reads all of its keys. See the README for why
whole documents go through lakeweave.llm.bpe instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeweave.llm.common import pick

#: Maps that the rank table is dealt to.
MAPS = 1 << 16


def rank_maps(ranks: dict[bytes, int]) -> Column:
    """The rank table as a literal: maps from a token in hex to its rank, by hash of the token."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        maps[_place(token)][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _place(token: bytes) -> int:
    """Where a token's map is: the XXH64 of its hex, as Spark's xxhash64 has it."""
    return xxh64_intdigest(token.hex().upper(), 42) % MAPS


def _rank(maps: Column, token: Column) -> Column:
    """The rank of a token in hex, null if it has none."""
    # MAPS is a power of two, so the low bits are the remainder of the unsigned hash
    return F.try_element_at(F.get(maps, F.xxhash64(token).bitwiseAND(F.lit(MAPS - 1)).cast("int")), token)


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merge_once(maps: Column, parts: Column) -> Column:
    """Joins the adjacent pair of lowest rank, the leftmost of equals; no change if no pair has one."""
    n = F.size(parts)
    pairs = F.zip_with(F.slice(parts, 1, n - 1), F.slice(parts, 2, n - 1), lambda a, b: _rank(maps, F.concat(a, b)))

    def joined(ranks: Column) -> Column:
        low = F.array_min(ranks)
        at = F.array_position(ranks, low).cast("int")
        both = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
        return F.when(low.isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), both, F.slice(parts, at + 2, n)))

    return F.when(n < 2, parts).otherwise(_bound(pairs, joined))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word, ids (array<int>) and decoded (binary) of each row of words (word: one match of the splitting pattern).

    Nulls and empty words have no ids. Every step of the fold merges at most one pair, so a
    word of n bytes takes n - 1 steps of n lookups.
    """
    maps = rank_maps(ranks)
    token = F.hex(F.encode(F.coalesce("word", F.lit("")), "UTF-8"))
    pieces = F.regexp_extract_all(token, F.lit("(..)"), F.lit(1))
    rows = pick(words, "word").withColumn("token", token).withColumn("pieces", pieces)
    steps = F.sequence(F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(1)))
    folded = F.aggregate(steps, F.col("pieces"), lambda parts, _: _merge_once(maps, parts))
    whole = F.when(_rank(maps, F.col("token")).isNotNull(), F.array("token")).otherwise(folded)
    merged = rows.withColumn("parts", whole)
    decoded = F.unhex(F.array_join("parts", ""))
    return merged.select("word", F.transform("parts", lambda p: _rank(maps, p)).alias("ids"), decoded.alias("decoded"))

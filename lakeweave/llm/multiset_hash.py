"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph's pieces are hashed into wide vectors that are summed lane by lane modulo a
power of two. The sum does not depend on order, and paragraphs are inserted or deleted by
adding or subtracting their vectors. Pieces are runs of a few words, cut after clause
marks and after words that end in n, s, t or a, so that where they end depends on nearby
letters only; what is longer without such an end, in scripts without spaces say, gives its
runs of four characters. There are two kinds of lanes, all of 32 bits:

* eight from whole paragraphs, by hashes of four different seeds, which decide equality;
* 63 that count how often a hash bit is set among the pieces. Twice that count less the
  number of pieces is a sum of random signs, so the squared distance of two such vectors
  estimates how many pieces the texts don't share.

Counts are packed three to a long, 21 bits each, while a part of a text is summed, and
taken apart before the parts are added, so no text is too long for them. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import pick

#: Equality lanes, and the modulus of all lanes.
WIDE, MODULUS = 8, 1 << 32
#: While a part of a text is summed: longs, lanes in each, bits of a lane, and units of a part.
PACKED, PER_LONG, LANE_BITS, PART_UNITS = 21, 3, 21, 1 << 20
LANES, LANE = PACKED * PER_LONG, (1 << LANE_BITS) - 1
MASK = 1 | 1 << LANE_BITS | 1 << 2 * LANE_BITS
#: Characters that a piece may have before it is taken in runs of RUN.
LONGEST, RUN = 256, 4
#: Rows that one range of ids holds about.
RANGE_ROWS = 4096
#: Ranges at most; beyond MOST_RANGES * RANGE_ROWS rows the ranges grow instead.
MOST_RANGES = 1 << 15
_LEAST = -(1 << 63)


def _runs(piece: Column) -> Column:
    """A long piece as its runs of RUN neighbouring characters."""
    chars = F.split(piece, "")
    n = F.size(chars) - (RUN - 1)
    joined = F.slice(chars, 1, n)
    for k in range(1, RUN):
        joined = F.zip_with(joined, F.slice(chars, k + 1, n), lambda a, b: F.concat(a, b))
    return joined


def _units(text: Column) -> Column:
    """Paragraphs (whole, true) and their pieces (whole, false); blank ones are left out."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    pieces = F.filter(F.split(text, r"\n|(?<=[.!?|,;:*$%&#nsta])\s+|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"), lambda p: p != "")
    long = lambda p: F.length(p) > LONGEST
    pieces = F.when(F.exists(pieces, long), F.concat(F.filter(pieces, lambda p: ~long(p)), F.flatten(F.transform(F.filter(pieces, long), _runs)))).otherwise(pieces)
    tag = lambda a, whole: F.transform(a, lambda p: F.struct(p.alias("part"), F.lit(whole).alias("whole")))
    return F.concat(tag(paragraphs, True), tag(pieces, False))


def _summed(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """The vector v (wide, lanes, n) of the text of each row; keys tell rows apart."""
    units = rows.select(*keys, F.posexplode_outer(_units(text)).alias("at", "u"))
    part, whole = F.col("u.part"), F.col("u.whole")
    hashes = [F.when(whole, F.xxhash64(F.lit(k), part)).alias(f"h{k}") for k in range(WIDE // 2)]
    hashed = units.select(*keys, F.expr(f"at div {PART_UNITS}").alias("chunk"), *hashes, F.when(~whole, F.xxhash64(F.lit(WIDE), part)).alias("h"))
    wide = []
    for k in range(WIDE // 2):
        wide += [F.sum(F.col(f"h{k}").bitwiseAND(F.lit(MODULUS - 1))), F.sum(F.shiftrightunsigned(f"h{k}", 32))]
    packed = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(MASK))) for k in range(PACKED)]
    names = [*(f"w{k}" for k in range(WIDE)), *(f"l{k}" for k in range(PACKED))]
    parts = hashed.groupBy(*keys, "chunk").agg(*[c.alias(n) for c, n in zip(wide + packed, names, strict=True)], F.count("h").alias("n"))
    lane = lambda i: F.shiftrightunsigned(f"l{i % PACKED}", i // PACKED * LANE_BITS).bitwiseAND(F.lit(LANE))
    told = F.struct(F.array(*[F.coalesce(F.pmod(f"w{k}", F.lit(MODULUS)), F.lit(0)) for k in range(WIDE)]).alias("wide"), F.array(*[F.coalesce(lane(i), F.lit(0)) for i in range(LANES)]).alias("lanes"), F.col("n"))
    # the parts of one text: a text has one for each PART_UNITS of its units
    sums = parts.groupBy(*keys).agg(F.collect_list(told).alias("p"))
    first = F.get("p", F.lit(0))
    return sums.select(*keys, F.when(F.size("p") == 1, first).otherwise(F.aggregate(F.slice("p", 2, F.size("p")), first, lambda a, b: combine(a, b))).alias("v"))


def _signs(v: Column) -> Column:
    """The sums of signs of a vector (wide, lanes, n)."""
    return F.transform(v["lanes"], lambda x: (x * 2 - v["n"]).cast("double"))


def _square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def likeness(a: Column, b: Column) -> Column:
    """Of two vectors (wide, lanes, n): 1 if equal, else one less the share of unshared pieces, at least 0."""
    apart = _square(F.zip_with(_signs(a), _signs(b), lambda x, y: x - y))
    both = _square(_signs(a)) + _square(_signs(b))
    near = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(apart, both), F.lit(1.0)))
    return F.when((a["wide"] == b["wide"]) & (a["lanes"] == b["lanes"]), F.lit(1.0)).otherwise(F.least(near, F.lit(1.0)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the union of two multisets of paragraphs, or with sign -1 of the difference."""
    add = lambda x, y: x + y if sign > 0 else x - y
    lanes = lambda name: F.zip_with(a[name], b[name], lambda x, y: F.pmod(add(x, y), F.lit(MODULUS))).alias(name)
    return F.struct(lanes("wide"), lanes("lanes"), add(a["n"], b["n"]).alias("n"))


def printed(v: Column) -> Column:
    """The vector as lower-case hex: equality lanes, likeness lanes, number of pieces."""
    return F.lower(F.array_join(F.transform(F.concat(v["wide"], v["lanes"], F.array(v["n"])), lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and the vector v of the text of each row; key must tell rows apart."""
    return _summed(rows, [key], F.coalesce(F.col(text), F.lit("")))


def _ranges(rows: DataFrame) -> tuple[list[int], int]:
    """Smallest ids of ranges with about RANGE_ROWS rows, and the smallest id; only this list goes to the driver."""
    first = rows.agg(F.count("*").alias("n"), F.min("k").alias("k")).first()
    parts = min(MOST_RANGES, first["n"] // RANGE_ROWS + 1)
    if parts == 1:
        return [], first["k"] if first["n"] else 0
    at = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts).alias("at")).first()["at"]
    return sorted({x for x in at if x > first["k"]}), first["k"]


def _range_of(k: Column, starts: list[int]) -> Column:
    """How many starts are at or below k: a coarse step over every 64th, then one within it."""
    coarse = starts[::64]
    below = lambda a: F.size(F.filter(a, lambda x: x <= k))
    listed = lambda a: F.array(*map(F.lit, a)).cast("array<bigint>")
    if not starts:
        return F.lit(0)
    blocks = F.array(*[listed(starts[i : i + 64]) for i in range(0, len(starts), 64)])
    block = below(listed(coarse))
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + below(F.get(blocks, block - 1)))


def with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (k, text) in ranges of k, each range with a copy of the next one's first rows.

    Adds part (the range) and copy (true for copied rows, which order after all others of
    the range). Texts are dealt out once, by part, so that what follows a row stands in its
    own part: no window spans all rows. A null k or text may not occur.
    """
    starts, least = _ranges(rows)
    heads = [least, *starts]
    is_head = F.col("k").isin(heads)
    part = _range_of(F.col("k"), starts).cast("int")
    last = len(starts)
    before = F.when(part == 0, F.lit(last)).otherwise(part - 1)
    here = F.struct(part.alias("part"), F.lit(False).alias("copy"))
    spread = F.when(is_head, F.array(here, F.struct(before.alias("part"), F.lit(True).alias("copy")))).otherwise(F.array(here))
    return rows.withColumn("to", F.explode(spread)).select("*", "to.part", "to.copy").drop("to"), Window.partitionBy("part").orderBy("copy", "k", "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text) and of its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next row by doc_id (the last row's next is the first). A null text
    counts as empty; the fingerprint of an empty text is all zeros. A null doc_id comes
    first; rows of one doc_id follow each other by text. Each input row gives one row.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    spread, order = with_next(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    placed = spread.withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))
    placed = placed.select("part", "at", "copy", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.when(~F.col("copy"), F.col("edited")).otherwise("").alias("t")))
    keys = ["part", "nth", "which", "copy", "doc_id", "n_chars", "edited_sha256"]
    each = placed.select(F.col("part"), F.col("at").alias("nth"), "copy", "doc_id", "n_chars", "edited_sha256", F.explode(texts).alias("x")).withColumn("which", F.col("x.which"))
    sums = _summed(each, keys, F.col("x.t"))
    # in order: a text, its edited text, the next text
    order = Window.partitionBy("part").orderBy("nth", "which")
    after = sums.withColumn("w", F.lead("v", 1).over(order)).withColumn("x", F.lead("v", 2).over(order)).where((F.col("which") == 0) & ~F.col("copy"))
    v, w, x = F.col("v"), F.col("w"), F.col("x")
    return after.select("doc_id", "n_chars", "edited_sha256", printed(v).alias("fingerprint"), printed(w).alias("edited_fingerprint"), likeness(v, w).alias("near_edited"), likeness(v, x).alias("near_next"))

"""Learnt models on held-out rows, fingerprints, mixing, and the pipeline as a whole."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import language_id, mixing, multiset_hash, near_copies, quality_model, queries
from lakeweave.llm.trees import fit_forest


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def larger(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_language(spark, larger):
    rows = language_id.identify(larger).join(larger.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) > 100


def test_language_ignores_what_is_held_out(larger):
    bent = larger.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda r: r["doc_id"]
    assert sorted(language_id.identify(bent).collect(), key=key) == sorted(language_id.identify(larger).collect(), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len({tuple(c) for c in code}) == n


def test_decoding_survives_a_wrong_bit():
    code = language_id.codewords(9)
    model = language_id.Model([str(i) for i in range(9)], code, None, None, np.ones(code.shape[1], np.float32))
    for bit in range(code.shape[1]):
        margins = 2 * code.copy()
        margins[:, bit] *= -1
        best, share, lead = language_id.decode(model, margins)
        assert best.tolist() == list(range(9)) and (lead > 0).all() and (share <= 1).all()


def test_quality(spark, larger, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality_model.score_quality(larger, labels).collect()
    assert len(rows) == larger.count()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in out) >= 0.95 * len(out) > 40
    bent = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: r["doc_id"]
    assert sorted(quality_model.score_quality(larger, bent).collect(), key=key) == sorted(rows, key=key)


def test_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(float)
    forest = fit_forest(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert fit_forest(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_edited_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", 17)
    rows = multiset_hash.document_fingerprints(docs.repartition(5)).collect()
    found = {r["doc_id"]: r for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(text)
    assert len(rows) == len(order)
    for i, k in enumerate(order):
        t, n = text[k], text[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = found[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in rows}) == len(set(text.values()))
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.9 * len(rows)
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", 4096)
    key = lambda r: r["doc_id"]
    assert sorted(multiset_hash.document_fingerprints(docs).collect(), key=key) == sorted(rows, key=key)


def test_multiset_arithmetic(spark):
    texts = ["one here.\ntwo there.\nthree", "three\none here.\ntwo there.", "three", "one here.\ntwo there.", "one here.\ntwo there.\ntwo there.\nthree", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    v = {r["id"]: r["v"] for r in multiset_hash.vectors(df, "id", "t").collect()}
    assert v[0] == v[1] and v[0] != v[4] and v[5]["n"] == 0
    pairs = multiset_hash.vectors(df, "id", "t").alias("a").join(multiset_hash.vectors(df, "id", "t").alias("b"), F.expr("a.id = 2 AND b.id = 3"))
    plus = pairs.select(multiset_hash.combine(F.col("a.v"), F.col("b.v")).alias("s")).select("s", multiset_hash.printed(F.col("s")).alias("p"))
    assert plus.first()["s"] == v[0]
    minus = pairs.select(multiset_hash.combine(multiset_hash.combine(F.col("a.v"), F.col("b.v")), F.col("b.v"), -1).alias("s")).first()["s"]
    assert minus == v[2]


def plain_vector(text):
    """The fingerprint word for word."""
    mixed = lambda k, part: xxhash.xxh64(part.encode(), seed=xxhash.xxh64(k.to_bytes(4, "little"), seed=42).intdigest()).intdigest()
    paragraphs = [p for p in text.split("\n") if p]
    pieces = [p for p in re.split(r"\n|(?<=[.!?|,;:*$%&#nsta])[ \t\n\x0b\f\r]+|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])", text) if p]
    pieces = [x for p in pieces for x in ([p] if len(p) <= 256 else [p[i : i + 4] for i in range(len(p) - 3)])]
    lanes = []
    for k in range(4):
        h = [mixed(k, p) for p in paragraphs]
        lanes += [sum(x & 0xFFFFFFFF for x in h), sum(x >> 32 for x in h)]
    h = [mixed(8, p) for p in pieces]
    lanes += [sum(x >> i % 21 + i // 21 * 21 & 1 for x in h) for i in range(63)]
    return "".join(f"{x % 2**32:08x}" for x in [*lanes, len(h)])


def test_fingerprints_by_hand(spark, docs):
    texts = [r["text"] for r in docs.collect()][:60] + ["", "\n\n", "one line", "今天天气很好，我们去公园。明天不去！", "ก" * 300, "x" * 257, "x" * 256, "a  b\nb s  c", "tab t\tand s\x0bv"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.document_fingerprints(df).collect()}
    assert found == {i: plain_vector(t) for i, t in enumerate(texts)}


def test_fingerprints_of_very_long_texts(spark):
    """Five million pieces, all alike; the longest lanes hold what 21 bits do not."""
    texts = ["a " * 5_000_000, "b s\n" * 400_000, "x" * 600_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = {r["doc_id"]: r for r in multiset_hash.document_fingerprints(df).collect()}
    n = [int(rows[i]["fingerprint"][-8:], 16) for i in range(4)]
    assert n == [5_000_000, 400_000, 599_997, 0]
    assert {int(rows[0]["fingerprint"][64 + 8 * i : 72 + 8 * i], 16) for i in range(63)} == {0, 5_000_000}
    assert rows[0]["n_chars"] == 10_000_000 and rows[3]["near_edited"] == 1.0
    assert rows[1]["fingerprint"] == plain_vector(texts[1])


def test_likeness_in_any_script(spark):
    """Half of a text without spaces or marks is shared with its edited text, nothing with the next one."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(low, low + 4000, 3000))) for low in (0x4E00, 0xAC00, 0x4E00, 0xAC00)]
    rows = multiset_hash.document_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(0.25 < r["near_edited"] < 0.8 and r["near_next"] < 0.3 for r in rows)


def test_fingerprints_are_native(docs):
    plan = multiset_hash.document_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("each", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 3, "c": 1, "d": 1}, {"a": 50, "b": 31, "c": 19}, {f"s{i}": i for i in range(1, 30)}])
def test_cycle_stays_within_a_block(each):
    plan = mixing.pfair_cycle(each)
    total, seen = sum(each.values()), dict.fromkeys(each, 0)
    for t, (s, j) in enumerate(plan):
        assert j == seen[s]
        seen[s] += 1
        assert all(abs(n - each[k] * (t + 1) / total) < 1 for k, n in seen.items())
    assert seen == each


def test_mix(spark, larger):
    weights = {"src0": 5.0, "src1": 1.0, "src2": 3.0}
    rows = mixing.mix_sources(larger, weights, block_rows=2, cycle=100).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in larger.select("doc_id").collect())
    assert len({r["position"] for r in rows}) == len(rows)
    blocks = {(r["slot"], r["source"], r["block"], r["phase"]) for r in rows}
    assert len({b[0] for b in blocks}) == len(blocks)
    for phase in ("target", "rest"):
        slots = sorted(b for b in blocks if b[3] == phase)
        assert [b[0] for b in slots] == sorted({b[0] for b in slots})
    target = sorted(b for b in blocks if b[3] == "target")
    share = sum(b[1] == "src0" for b in target) / len(target)
    assert target and abs(share - 5 / (9 + 17 * 3)) < 0.06
    assert sorted(mixing.mix_sources(larger.repartition(7), weights, block_rows=2, cycle=100).collect()) == sorted(rows)


def test_mix_keeps_to_the_given_weights(spark):
    """85 sources of which one has a third of the weight, and weights that no short cycle holds."""
    weights = {"hot": 1 / 3, **{f"s{i}": (2 / 3) * (i + 1) / 44_850 for i in range(299)}}
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") * F.col("id") % 299).cast("string"))).alias("source"))
    weights = {r["source"]: weights[r["source"]] for r in rows.select("source").distinct().collect()}
    order = [r["source"] for r in mixing.mix_sources(rows, weights, block_rows=1).where("phase = 'target'").orderBy("slot").collect()]
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    assert len(order) > 3000 and len(weights) == 85
    for t, s in enumerate(order):
        seen[s] += 1
        assert abs(seen[s] - weights[s] / total * (t + 1)) < 1 + 1e-6
        assert abs(seen["hot"] - weights["hot"] / total * (t + 1)) < 1 + 1e-6


def test_blocks_grow_with_the_table(spark, larger, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    rows = mixing.mix_sources(larger, block_rows=2).collect()
    n = len(rows)
    assert n == larger.count() and max(r["in_block"] for r in rows) == -(-n // 40) - 1
    assert len({r["position"] for r in rows}) == n and len({(r["source"], r["block"]) for r in rows}) <= 40 + len({r["source"] for r in rows})


def test_mixed_documents_are_all_there_in_order(spark, larger):
    out = [r["doc_id"] for r in mixing.mixed_documents(larger).collect()]
    places = {r["doc_id"]: r["position"] for r in mixing.mix_sources(larger).collect()}
    assert out == sorted(places, key=places.get)


def test_pipeline(spark, small, docs):
    rows = corpus_pipeline.run(spark, small).collect()
    kept = language_id.keep_identified(docs)
    want = {r["doc_id"] for r in near_copies.drop_near_copies(kept).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def test_mix_of_very_many_sources(spark):
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    out = mixing.mix_sources(rows).agg(F.count("*"), F.countDistinct("position"), F.countDistinct("source")).first()
    assert tuple(out) == (20_500, 20_500, 20_500)

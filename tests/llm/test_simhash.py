import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import simhash
from lakeweave.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """id to smallest reachable id, by comparing everything with everything."""
    ids, up = sorted(fps), {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    bits = np.array([fps[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(bits[a] ^ bits[a + 1 :]) <= 2):
            x, y = sorted((root(i), root(ids[a + 1 + b])))
            up[y] = x
    return {i: root(i) for i in ids}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBzZ É\t\n\x0b\x1c é😀-", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents(spark, docs):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in found.items()} == plain_components(fps)


@pytest.mark.parametrize("paired", [1, 4, 48])
def test_links_of_crowded_fingerprints(spark, paired):
    """Chains and balls of close fingerprints: hot postings take the other way and give the same components."""
    rng = random.Random(paired)
    centre, fps = rng.getrandbits(64), {}
    for i in range(120):
        x = centre
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps[x] = i
    x = rng.getrandbits(64)
    for i in range(200, 260):  # a chain in steps of two bits, the sign bit included
        fps[x] = i
        x ^= (1 << (63 - i % 60)) | (1 << (i % 60))
    nodes = {i: x for x, i in fps.items()}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes.items()], "node long, fp long")
    want = plain_components(nodes)
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(df, paired)).collect()}
    assert {i: found.get(i, i) for i in nodes} == want
    assert len(set(want.values())) < len(nodes) / 2


def test_components(spark):
    n = 300
    path = [(i, i + 1) for i in range(0, n)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame([*path, *star, *star[:50], (5, 5), (None, 3), (2000, 1999), (1999, 2001)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {found[i] for i in range(n + 1)} == {0}
    assert {found[1000 + i] for i in range(400)} == {1000}
    assert found[2001] == found[2000] == found[1999] == 1999
    assert connected_components(edges.where("false")).count() == 0


def test_postings_tally_shared_bytes():
    """Six equal bytes share three postings at least, five or fewer share one at most, whichever they are."""
    assert len(simhash.POSTINGS) == 14
    for n in range(9):
        for equal in combinations(range(8), n):
            shared = sum(set(p) <= set(equal) for p in simhash.POSTINGS)
            assert shared >= simhash.LEAST_SHARED if n >= 6 else shared <= 1


def test_pairs_under_the_tally_are_dropped(spark):
    """Equal in four bytes of one posting only: such a pair is met, counted once and dropped before the bits are compared."""
    a, b = 0x1111111111111111, 0x1111111122222222
    df = spark.createDataFrame([(0, a), (1, b), (2, a ^ 1), (3, b ^ 0x8000)], "node long, fp long")
    assert {(r["a"], r["b"]) for r in simhash.links(df).collect()} == {(0, 2), (1, 3)}

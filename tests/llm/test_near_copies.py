import random

import numpy as np
import pytest

from lakeweave.llm import near_copies, simhash


def similar(a, b):
    x, y = (set(near_copies.shingles(t).tolist()) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def planted(n_groups=12, size=9, words=160, edits=2, seed=4):
    """Texts of random words, each with copies of which a few words are changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = []
    for g in range(n_groups):
        base = [word() for _ in range(words)]
        for k in range(size):
            text = base[:]
            for _ in range(edits if k else 0):
                text[rng.randrange(words)] = word()
            rows.append((len(rows), " ".join(text), g))
    return rows


@pytest.mark.parametrize("paired", [8, 4])
def test_planted_copies(spark, paired):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, g int").repartition(5)
    kept = [r["doc_id"] for r in near_copies.drop_near_copies(df, paired=paired).collect()]
    assert sorted(kept) == [r[0] for r in rows if r[0] % 9 == 0]


def test_survivors_and_dropped(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()}
    sets = {i: frozenset(near_copies.shingles(t).tolist()) for i, t in text.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    order = sorted(kept)
    left = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if near(a, b)]
    assert len(left) <= 0.05 * (len(text) - len(kept))
    for i in set(text) - kept:
        assert any(near(i, j) for j in text if j != i)


def test_shingles():
    assert len(near_copies.shingles("")) == 0 and len(near_copies.shingles("A b")) == 1
    assert len(near_copies.shingles("a b c d e f")) == 2
    assert np.array_equal(near_copies.shingles("A b  C d e"), near_copies.shingles("a B c d\te"))
    assert similar("x " * 9, "X " * 30) and not similar("a b c d e f", "a b c d e g")


def test_frequent_shingles_are_counted_over_all_documents(spark, docs):
    counts = {}
    for r in docs.collect():
        for x in near_copies.shingles(r["text"]).tolist():
            counts[x] = counts.get(x, 0) + 1
    listed = near_copies.frequent(docs.repartition(3), 200)
    want = {}
    for x, n in counts.items():
        want[x >> 64 - listed.bits] = want.get(x >> 64 - listed.bits, 0) + n
    want = {h: n for h, n in want.items() if n >= near_copies.FREQUENT}
    assert dict(zip(listed.heads.tolist(), listed.times.tolist(), strict=True)) == want and len(want) > 5
    fewer = near_copies.frequent(docs, 200, most=5)
    assert len(fewer.heads) <= 5 and min(fewer.times, default=10**9) > sorted(want.values())[-6]


def test_the_order_of_shingles_changes_no_result(spark):
    rows = [(i, t) for i, t, _ in planted(4, 30, 120, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(df).collect()) == want
    nodes = near_copies.signatures(df).groupBy("same").agg({"doc_id": "min"}).toDF("same", "node")
    none = near_copies.Frequent(40, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    a, b = ({(r["x"], r["y"]) for r in near_copies._pairs(near_copies.postings(df, o).selectExpr("*", "m AS g"), 0.8, 1000).collect()} for o in (none, near_copies.frequent(df, 1)))
    same = {r["node"]: r["same"] for r in nodes.collect()}
    close = {tuple(sorted((same[i], same[j]))) for i, t in rows for j, u in rows if i < j and i in same and j in same and similar(t, u)}
    assert close and close <= a and close <= b


def test_repeated_ids_keep_the_same_row(spark):
    rows = [(1, f"text {k} " + "word " * k) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for n in (1, 3, 7) for r in near_copies.drop_near_copies(df.repartition(n)).collect()}
    assert len(kept) == 1


def test_case_and_spaces_do_not_matter(spark):
    df = spark.createDataFrame([(5, "One two  three"), (3, "one TWO\nthree"), (9, "one two four"), (7, None), (8, " "), (None, "one two three")], "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop_near_copies(df).collect()} == {3, 9, 7, None}


def brute_force(rows):
    """The ids that stay when all pairs are compared."""
    sets = {i: frozenset(near_copies.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return sorted(i for i, r in root.items() if r == i)


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_added_removed_and_replaced_passages(spark):
    rng, rows = random.Random(8), []
    for g in range(30):
        base = words_of(rng, 200)
        rows.append(" ".join(base))
        n = (12, 22, 34)[g % 3]
        rows.append(" ".join(base + words_of(rng, n)))
        rows.append(" ".join(base[:80] + base[80 + n :]))
        rows.append(" ".join(base[:80] + words_of(rng, n // 2) + base[80 + n // 2 :]))
    rows = list(enumerate(rows))
    kept = [r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == brute_force(rows)


@pytest.mark.parametrize("paired", [48, 4, 2])
def test_crowded_postings_and_chains(spark, paired):
    """Chains, each text a passage away from the one before, so that the last are linked through dropped ones only."""
    rng, rows = random.Random(9), []
    for _ in range(4):
        text = words_of(rng, 150)
        for k in range(60):
            rows.append(" ".join(text))
            at = rng.randrange(130)
            text = text[:at] + words_of(rng, 8) + text[at + 8 :]
            if k % 20 == 19:
                text = text[:60] + words_of(rng, 90)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = [r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), paired=paired).collect()]
    assert sorted(kept) == brute_force(rows)


def test_simhash_finds_copies_before_the_exact_way(spark, monkeypatch):
    """SimHash's groups give links of their own, without the index of shingles; the check takes out what is alike by SimHash only."""
    rng = random.Random(12)
    passage, text = words_of(rng, 100) * 40, words_of(rng, 900)
    texts = [" ".join(passage + words_of(rng, n)) for n in (30, 50)] + [" ".join(text), " ".join([*text, "end"]), " ".join(words_of(rng, 120))]
    bits = lambda x, y: (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count()
    assert max(bits(*texts[:2]), bits(*texts[2:4])) <= simhash.MOST_BITS and not similar(*texts[:2]) and similar(*texts[2:4])
    rows = [(5, texts[0]), (3, texts[1]), (8, texts[2]), (6, texts[3]), (4, texts[4]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = near_copies.postings(df, near_copies.Frequent(40, np.zeros(0, np.uint64), np.zeros(0, np.int32))).where("false")
    monkeypatch.setattr(near_copies, "postings", lambda *_: none)
    kept = [r["doc_id"] for r in near_copies.drop_near_copies(df).collect()]
    assert sorted(kept, key=str) == [3, 4, 5, 6, None]

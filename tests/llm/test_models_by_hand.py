"""The learnt models against plain versions: splits and traversal of the trees, language bits and decoding, licence notices, labels of page nodes, automata."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.ml.feature import HashingTF

from lakeweave.llm import html_text, language_id, licenses, quality_model, secrets
from lakeweave.llm.trees import fit_forest


def plain_score(forest, row):
    """One row down every tree, node by node."""
    total = forest.start
    for t in range(len(forest.feature)):
        at = 0
        while at < 2**forest.depth - 1 and (j := forest.feature[t][at]) >= 0:
            at = 2 * at + (2 if row[j] > forest.cut[t][at] else 1)
        total += forest.value[t][at]
    return 1 / (1 + math.exp(-total))


def plain_split(x, g, h, cuts, ridge, least):
    """The best (gain, feature, cut) by trying each cut of each feature; None if none is allowed."""
    best = None
    part = lambda on: sum(g[i] for i in on) ** 2 / (sum(h[i] for i in on) + ridge)
    for j in range(len(x[0])):
        for cut in cuts[j]:
            left, right = [i for i in range(len(x)) if x[i][j] <= cut], [i for i in range(len(x)) if x[i][j] > cut]
            if min(len(left), len(right)) >= least:
                gain = part(left) + part(right) - part(range(len(x)))
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, j, cut
    return best


@pytest.mark.parametrize("seed", range(6))
def test_first_splits(seed):
    """The root and both of its children split where trying everything says, or not at all."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(90, 4)), 1 if seed % 2 else 6)
    y = (x[:, seed % 4] + rng.normal(size=90) * 0.7 > 0.3).astype(float)
    forest = fit_forest(x, y, trees=1, depth=2, bins=12, ridge=1.0, least=8)
    cuts = [sorted({float(c) for c in np.quantile(x[:, j], np.linspace(0, 1, 13)[1:-1])}) for j in range(4)]
    p = 1 / (1 + math.exp(-forest.start))
    nodes = {0: list(range(90))}
    for node in (0, 1, 2):
        rows = nodes.get(node, [])
        best = plain_split(x[rows].tolist(), [p - y[i] for i in rows], [p * (1 - p)] * len(rows), cuts, 1.0, 8) if rows else None
        j = int(forest.feature[0][node])
        if best is None:
            assert j == -1
            continue
        assert (j, forest.cut[0][node]) == (best[1], pytest.approx(best[2]))
        nodes[2 * node + 1], nodes[2 * node + 2] = [i for i in rows if x[i][j] <= best[2]], [i for i in rows if x[i][j] > best[2]]
    for node, rows in nodes.items():
        if forest.feature[0][node] == -1 and rows:
            assert forest.value[0][node] == pytest.approx(-0.15 * sum(p - y[i] for i in rows) / (sum(p * (1 - p) for _ in rows) + 1.0))


def test_scores_of_the_query(spark, data):
    """Every document's score is that of a forest fitted on the same rows and walked node by node."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    ids = sorted(known.keys() & texts.keys())
    forest = fit_forest(np.array([quality_model.statistics(texts[i]) for i in ids], float), np.array([known[i] for i in ids], float))
    found = {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs, labels).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        assert found[i] == pytest.approx(plain_score(forest, quality_model.statistics(text)), abs=1e-9)


def plain_margins(model, text):
    """The bits' margins of a text, trigram by trigram."""
    b = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in text.lower().encode())
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    b = b" " + b + b" "
    times = Counter((int.from_bytes(b[i : i + 3], "big") * 2654435761) % 2**32 >> 19 for i in range(len(b) - 2))
    length = math.sqrt(sum(times.values()))
    return [sum(math.sqrt(n) / length * float(model.weights[k, j]) for k, n in times.items()) + float(model.offsets[j]) for j in range(len(model.offsets))]


def plain_decode(model, margins):
    """The language of the least weighted loss, its share, and the lead."""
    losses = [sum(float(w) * math.log1p(math.exp(-m * float(c))) for w, m, c in zip(model.bit_weights, margins, code, strict=True)) for code in model.codewords]
    near = [math.exp(min(losses) - x) for x in losses]
    order = sorted(range(len(near)), key=lambda k: -near[k])
    return model.languages[order[0]], near[order[0]] / sum(near), (near[order[0]] - near[order[1]]) / sum(near)


def test_languages_of_the_query(spark, docs):
    model = language_id.learn(docs.select("doc_id", "text", "lang"), docs.doc_id.isNotNull())
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    checked = 0
    for r in docs.collect():
        if r["text"] and any(c.isalpha() for c in r["text"]) and len(r["text"]) < 5000:
            lang, share, lead = plain_decode(model, plain_margins(model, r["text"]))
            got = found[r["doc_id"]]
            assert got["score"] == pytest.approx(share, abs=1e-3)
            if abs(lead) > 1e-3:
                assert got["lang_pred"] == lang
            if abs(lead - 0.05) > 1e-3:
                assert got["ambiguous"] == (lead < 0.05)
            checked += 1
    assert checked > 150


@pytest.mark.parametrize("n", [3, 9, 40])
def test_decoding_by_hand(n):
    rng = np.random.default_rng(n)
    code = language_id.codewords(n)
    weights = rng.uniform(0.05, 1, code.shape[1]).astype(np.float32)
    model = language_id.Model([str(i) for i in range(n)], code, None, None, weights)
    margins = rng.normal(size=(200, code.shape[1])) * 3
    best, share, lead = language_id.decode(model, margins)
    for k in range(200):
        lang, s, gap = plain_decode(model, margins[k])
        assert model.languages[best[k]] == lang and share[k] == pytest.approx(s) and lead[k] == pytest.approx(gap, abs=1e-9)


def plain_notices(level, weights, offsets, index_of, text):
    """Families and probabilities of all lines of a text that name a licence, without any shortcut by stems."""
    out = []
    for line in (text or "").split("\n"):
        w = plain_words(line)
        own = plain_pairs(w)
        sums = (weights[:, sorted({index_of(g) for g in w + own})].sum(1) + offsets).tolist()
        shares = [math.exp(s - max(sums)) for s in sums]
        best = max(range(len(sums)), key=sums.__getitem__)
        p = shares[best] / sum(shares)
        if best == 0 or p < level:
            continue
        family = licenses.FAMILIES[best]
        common = {p for n in licenses.INVENTED for f in licenses.FRAMES for p in plain_pairs(plain_words(f.format(n)))}
        telling_own = set(own) - common
        for t in licenses.TEMPLATES[family] + licenses.NAMES[family]:
            ours = set(plain_pairs(plain_words(t))) or set(plain_words(t))
            ours = ours - common or ours
            if len(ours & (telling_own | set(w))) >= 0.7 * min(len(ours), max(len(telling_own), 2)):
                out.append((family, p))
                break
    return out


def plain_words(text):
    return [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]


def plain_pairs(w):
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def test_licences_of_the_query(spark, docs):
    planted = ["Released under the MIT License.\nReleased under the MIT License.", "License: Acme Public License, version 2\nunder GPLv3 or later", "A licence to drive.", "SPDX-License-Identifier: ISC\nsome words\n\nLicensed under CC BY-SA 4.0.", None, ""]
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(80).collect() + [(5000 + i, t) for i, t in enumerate(planted)]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    fitted = licenses.learn(df)
    told = (fitted.level, fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray())
    texts = [(t or "").split("\n") for _, t in map(tuple, rows)]
    terms = sorted({g for lines in texts for line in lines for w in [plain_words(line)] for g in w + plain_pairs(w)})
    hashed = HashingTF(numFeatures=licenses.FEATURES, inputCol="g", outputCol="x").transform(spark.createDataFrame([([t],) for t in terms], "g array<string>"))
    index_of = {r["g"][0]: int(r["x"].indices[0]) for r in hashed.collect()}.__getitem__

    found = {r["doc_id"]: r for r in licenses.scan_licenses(df, fitted).collect()}
    assert len(found) == len(rows)
    for doc_id, text in map(tuple, rows):
        want, got = plain_notices(*told, index_of, text), found[doc_id]
        assert got["n_notices"] == len(want)
        assert got["families"] == ",".join(sorted({f for f, _ in want}))
        assert got["score"] == pytest.approx(max((p for _, p in want), default=0.0))


@pytest.mark.parametrize("seed", range(20))
def test_labels_of_nodes_by_trying_all(seed):
    """The decoded labels are the likeliest of all that run outside, inside, foreign along every path."""
    rng = random.Random(seed)
    n = rng.randint(1, 8)
    page = html_text.Page("")
    page.tag, page.up = ["div"] * n, [-1] + [rng.randrange(i) for i in range(1, n)]
    p = np.array([rng.random() for _ in range(n)])
    allowed = [s for s in itertools.product((0, 1, 2), repeat=n) if s[0] != 2 and all((page.up[i] < 0 or s[page.up[i]] <= s[i]) and not (s[i] == 2 and s[page.up[i]] == 0) for i in range(n))]
    worth = lambda main: sum(math.log(q if m else 1 - q) for q, m in zip(p, main, strict=True))
    best = max(worth([x == 1 for x in s]) for s in allowed)
    got = page.decode(p)
    assert worth(got) == pytest.approx(best) and any([x == 1 for x in s] == got for s in allowed)


def test_automaton_without_chance_merges_tells_the_frequencies():
    """With a bound of zero only states that go on exactly alike merge, so each text keeps the frequency that counting gives."""
    rng = random.Random(4)
    for _ in range(20):
        times = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 4))): rng.randint(3, 9) for _ in range(12)}
        learnt = secrets.Automaton([x for x, n in times.items() for _ in range(n)], alpha=2.0)
        total = sum(times.values())
        for x, n in times.items():
            assert abs(learnt.score(secrets.symbols(x)) - math.log(n / total)) < 1e-9
        for q, moves in learnt.moves.items():
            ends = math.exp(learnt.ends[q])
            assert abs(sum(math.exp(p) for p, _ in moves.values()) + (ends if ends > 2 * secrets.UNSEEN else 0) - 1) < 1e-9


def test_automaton_merges_what_goes_on_alike():
    """Of marks that go on or end with one half each, one state is left, and longer runs than were seen get their probability."""
    samples = ["-" * k for k in range(11) for _ in range(1 << (10 - k))]
    learnt = secrets.Automaton(samples)
    assert len(learnt.moves) == 1
    marks = sum(map(len, samples))
    on = marks / (marks + len(samples))
    assert abs(learnt.score(["-"] * 20) - 20 * math.log(on) - math.log(1 - on)) < 1e-9
    # a mark that ends differently stays apart
    apart = secrets.Automaton(["x"] * 500 + ["y-"] * 500 + ["y"] * 100)
    assert len(apart.moves) > len(secrets.Automaton(["x"] * 500 + ["y"] * 500).moves)
    assert apart.score(["y", "-"]) > apart.score(["x", "-"])

"""Secret scans: fixed base rules, and formats learnt as probabilistic automata.

For each format a prefix tree of labelled credentials is built and its statistically
compatible states are merged (Hoeffding bound); the automaton that is left scores every
candidate token of every text against background models of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import arrow_map, bounded, mapped, pick

# The base rules. A match that fails its length is dropped, but still used up.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

#: Tokens that the automata score.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Published formats as (kind, [(literal) or (alphabet, least, most), ...]).
FORMATS = (
    ("git_token", ["ghp_", (LOWER + UPPER + DIGIT, 36, 36)]),
    ("git_fine_token", ["github_pat_", (LOWER + UPPER + DIGIT, 22, 22), "_", (LOWER + UPPER + DIGIT, 59, 59)]),
    ("package_token", ["npm_", (LOWER + UPPER + DIGIT, 36, 36)]),
    ("chat_token", ["xoxb-", (DIGIT, 11, 13), "-", (DIGIT, 11, 13), "-", (LOWER + UPPER + DIGIT, 24, 24)]),
    ("cloud_key", ["AIza", (LOWER + UPPER + DIGIT + "_-", 35, 35)]),
    ("payment_key", ["sk_live_", (LOWER + UPPER + DIGIT, 24, 34)]),
    ("signed_token", ["eyJ", (LOWER + UPPER + DIGIT, 20, 60), ".eyJ", (LOWER + UPPER + DIGIT, 20, 80), ".", (LOWER + UPPER + DIGIT + "_-", 30, 50)]),
)

#: The kind of credential that is learnt from the values of assignments in the texts themselves, and how many that takes.
ASSIGNED, LEAST_LABELLED = "assigned_value", 20
#: A format wins with this many nats over the best background in all, and a character.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.35
#: Probability of a transition that the training never saw.
UNSEEN = 1e-5
#: Inside a candidate, credentials may start after these characters or at a format's mark, and end before these.
STARTS = re.compile(r"(?<=[=/.+])|(?=" + "|".join(re.escape(parts[0]) for _, parts in FORMATS if isinstance(parts[0], str)) + ")")
ENDS = re.compile(r"[=/.+-]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in BASE_KINDS) of the base rules' matches, leftmost without overlap within each kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def symbols(token: str) -> list[str]:
    """Literal characters at the start, where formats carry their marks, and classes after it; specials stay literal."""
    kind = lambda c: "0" if c.isdigit() else "f" if c in "abcdef" else "z" if c in LOWER else "Z" if c in UPPER else c
    return [*token[:4], *map(kind, token[4:])]


class Automaton:
    """A deterministic probabilistic automaton: for each state the log probability and target of each symbol, and of the end."""

    def __init__(self, samples: list[str], alpha: float = 0.02):
        tree = _Tree()
        for s in samples:
            tree.add(symbols(s))
        tree.merge_compatible(alpha)
        self.moves = {q: {a: (math.log(n / tree.count[q]), t) for a, (n, t) in tree.out[q].items()} for q in tree.reachable()}
        self.ends = {q: math.log(max(tree.final[q] / tree.count[q], UNSEEN)) for q in self.moves}

    def score(self, seen: list[str]) -> float:
        """Log likelihood; an unseen symbol costs a fixed factor and leaves the state as it is."""
        q, total, moves, miss = 0, 0.0, self.moves, math.log(UNSEEN)
        for a in seen:
            step = moves[q].get(a)
            if step is None:
                total += miss
            else:
                total += step[0]
                q = step[1]
        return total + self.ends[q]


class _Tree:
    """A prefix tree with counts whose states can be merged."""

    def __init__(self):
        self.count, self.final, self.out = [0], [0], [{}]

    def add(self, seen: list[str]) -> None:
        q = 0
        self.count[0] += 1
        for a in seen:
            if a not in self.out[q]:
                self.out[q][a] = (0, len(self.count))
                self.count.append(0)
                self.final.append(0)
                self.out.append({})
            n, t = self.out[q][a]
            self.out[q][a] = (n + 1, t)
            self.count[t] += 1
            q = t
        self.final[q] += 1

    def reachable(self) -> list[int]:
        seen, todo = {0}, [0]
        while todo:
            for _, t in self.out[todo.pop()].values():
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sorted(seen)

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether no observed frequency of a and b, or of what follows them alike, differs by more than chance."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.count[a], self.count[b]
            allowed = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.final[a] / na - self.final[b] / nb) > allowed:
                return False
            for s in self.out[a].keys() | self.out[b].keys():
                fa, ta = self.out[a].get(s, (0, -1))
                fb, tb = self.out[b].get(s, (0, -1))
                if abs(fa / na - fb / nb) > allowed:
                    return False
                if ta >= 0 and tb >= 0 and ta != tb and self.count[tb] > 2:
                    todo.append((ta, tb))
        return True

    def fold(self, into: int, part: int) -> None:
        """Adds the subtree at part to the state into."""
        todo = [(into, part)]
        while todo:
            q, p = todo.pop()
            self.count[q] += self.count[p]
            self.final[q] += self.final[p]
            for s, (n, t) in self.out[p].items():
                if s in self.out[q]:
                    m, u = self.out[q][s]
                    self.out[q][s] = (m + n, u)
                    todo.append((u, t))
                else:
                    self.out[q][s] = (n, t)

    def merge_compatible(self, alpha: float) -> None:
        """States are settled breadth first: each next one joins the first settled state that it agrees with, or is settled itself."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        while True:
            fringe = sorted({(-self.count[t], t, q, s) for q in settled for s, (_, t) in self.out[q].items() if t not in settled})
            if not fringe:
                return
            _, t, q, s = fringe[0]
            for r in settled:
                if self.compatible(r, t, bound):
                    n, _ = self.out[q][s]
                    self.out[q][s] = (n, r)
                    self.fold(r, t)
                    break
            else:
                settled.append(t)


def made_samples(n: int, seed: int = 5) -> dict[str, list[str]]:
    """n credentials of each published format, from a fixed seed."""
    rng = random.Random(seed)
    part = lambda p: p if isinstance(p, str) else "".join(rng.choice(p[0]) for _ in range(rng.randint(p[1], p[2])))
    return {kind: ["".join(map(part, parts)) for _ in range(n)] for kind, parts in FORMATS}


def ordinary_samples(n: int, seed: int = 6) -> dict[str, list[str]]:
    """What long tokens of ordinary text look like: words, dotted or joined names, numbers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9)))
    joined = lambda: rng.choice("./-_=").join(rng.choice((word(), word().title(), word() + str(rng.randint(0, 99)), str(rng.randint(0, 2030)))) for _ in range(rng.randint(3, 6)))
    return {
        "words": ["".join(word() for _ in range(rng.randint(3, 5))).title() if rng.random() < 0.3 else "".join(word() for _ in range(rng.randint(3, 5))) for _ in range(n)],
        "shouts": ["".join(word() for _ in range(rng.randint(3, 5))).upper() for _ in range(n)],
        "joined": [joined() for _ in range(n)],
        "numbers": [rng.choice(("", "+", "-")) + rng.choice(("", "", ".", "-", "/")).join(str(rng.randint(0, 10**9)) for _ in range(rng.randint(2, 4))) for _ in range(n)],
    }


class _Background:
    """Symbol frequencies regardless of place."""

    def __init__(self, samples: list[str]):
        seen: dict[str, int] = {}
        for s in samples:
            for a in symbols("0000" + s)[4:]:
                seen[a] = seen.get(a, 0) + 1
        total = sum(seen.values())
        self.log = {a: math.log(n / total) for a, n in seen.items()}

    def score(self, seen: list[str]) -> float:
        return sum(self.log.get(a, math.log(1e-3)) for a in seen)


class Formats:
    """The automata of all formats and the background models."""

    def __init__(self, labelled: dict[str, list[str]], most: int = 120):
        samples = made_samples(most)
        samples |= {kind: found[:most] for kind, found in labelled.items() if len(found) >= LEAST_LABELLED}
        self.known = {kind: Automaton(s) for kind, s in samples.items()}
        self.longest = max(len(x) for s in samples.values() for x in s)
        self.ordinary = [_Background(s) for s in ordinary_samples(400).values()]

    def kind_of(self, token: str) -> str | None:
        """The likeliest format if it beats every background by enough, else None."""
        return self.lead_of(token)[1]

    def lead_of(self, token: str) -> tuple[float, str | None]:
        """By how many nats the likeliest format beats every background, and the format if that is enough."""
        seen, classes = symbols(token), symbols("0000" + token)[4:]
        kind, best = max(((k, a.score(seen)) for k, a in self.known.items()), key=lambda x: x[1])
        over = best - max(b.score(classes) for b in self.ordinary)
        # literal first symbols cost a format more than a class does
        return over, kind if over >= LEAST_TOTAL and over >= LEAST_EACH * len(token) else None


def labelled_credentials(docs: DataFrame, most_docs: int = 4000, most: int = 2000) -> dict[str, list[str]]:
    """Values of 20 characters or more with a digit that assignments label as secret in a bounded sample of docs (expected most_docs rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [m[2] for text in batch.column(1).to_pylist() if text for m in ASSIGN.finditer(text) if 20 <= len(m[2]) <= 128 and any(c in DIGIT for c in m[2])]
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})

    found = arrow_map(bounded(docs, "doc_id", most_docs), run, "value string").distinct()
    return {ASSIGNED: [r["value"] for r in found.orderBy(F.xxhash64("value"), "value").limit(most).collect()]}


class Scanner:
    """The spans of a text: by the base rules, and what the formats add."""

    def __init__(self, learnt: Formats):
        self.learnt = learnt
        self.order = {k: i for i, k in enumerate([*BASE_KINDS, *learnt.known])}

    def __call__(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(start, end, kind) of the base spans and of the added ones: of each run the likeliest parts that overlap no base span."""
        base = base_spans(text)
        more = []
        for m in CANDIDATE.finditer(text):
            run, at, scored = m[0], m.start(), []
            near = [(s - at, e - at) for s, e, _ in base if s < m.end() and at < e]
            for i, j in self.parts(run):
                if not any(s < j and i < e for s, e in near):
                    over, kind = self.learnt.lead_of(run[i:j])
                    if kind:
                        scored.append((-over, i, j, kind))
            taken = []
            for _, i, j, kind in sorted(scored):
                if not any(s < j and i < e for s, e, _ in taken):
                    taken.append((i, j, kind))
            more += [(at + i, at + j, kind) for i, j, kind in sorted(taken)]
        return [(s, e, BASE_KINDS[k]) for s, e, k in base], more

    def parts(self, run: str) -> list[tuple[int, int]]:
        """The whole run, and what may be a credential glued to something in it: no longer than the longest learnt one."""
        starts = sorted({0, *(m.start() for m in STARTS.finditer(run))})
        ends = [*(m.start() for m in ENDS.finditer(run)), len(run)]
        found = {(0, len(run.rstrip(".-=")))}
        for i in starts:
            for j in ends[bisect_left(ends, i + 20) :]:
                if j - i > self.learnt.longest:
                    break
                found.add((i, i + len(run[i:j].rstrip(".-="))))
        return sorted((i, j) for i, j in found if j - i >= 20)

    def joined(self, spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], self.order[x[2]])))


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """The secrets of each row of docs (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added (spans that
    the automata add to the base rules, also inside a URL, an assignment or a path). Spans count code points, the end exclusive. A
    null text counts as empty: no spans, the digest of nothing. What overlaps a base span
    is not added again. Each input row gives one row; equal rows give equal
    results; further columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    shared = rows.sparkSession.sparkContext.broadcast(Scanner(formats or Formats(labelled_credentials(rows))))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for batch in batches:
            counts, digests, spans, added = ([], [], []), [], [], []
            for scalar in batch.column(1):
                base, more = scan(scalar.as_py() or "")
                for kind, n in zip(BASE_KINDS, counts, strict=True):
                    n.append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(scan.joined(base).encode()).hexdigest())
                spans.append(scan.joined(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{n: pa.array(c, pa.int64()) for n, c in zip(("n_assign", "n_access", "n_hex"), counts, strict=True)}, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(added, pa.int64())})

    return arrow_map(rows, run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")


def without_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, named by the first."""
    out, end = [], 0
    for s, e, kind in sorted(spans):
        if s >= end:
            out += [text[end:s], f"[{kind}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """The rows of docs, all columns, with the secrets that scan_secrets() finds masked, and n_chars, where there is one, counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(formats or Formats(labelled_credentials(pick(docs, "doc_id", "text")))))

    def change(batch: pa.RecordBatch, at: dict[str, int]) -> pa.RecordBatch:
        scan, texts, sizes = shared.value, [], []
        for scalar in batch.column(at["text"]):
            text = scalar.as_py()
            if text and (spans := [x for found in scan(text) for x in found]):
                text = without_spans(text, spans)
            texts.append(text)
            sizes.append(None if text is None else len(text))
        columns = list(batch.columns)
        columns[at["text"]] = pa.array(texts, pa.string())
        if "n_chars" in at:
            columns[at["n_chars"]] = pa.array(sizes, pa.int64()).cast(columns[at["n_chars"]].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return mapped(docs, change)

"""Main text of web pages: boosted trees over the nodes of the page, decoded along the tree.

Each block element of a page is a node with features of its tag, its attribute tokens and
those around it, its depth, its siblings, and the density of text and links below it. The
trees give every node a probability of being main text. Decoding picks the likeliest
labels in which every path from the root runs outside, then inside the main text, then
inside something foreign to it: nothing below a foreign node is main text again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import arrow_map, pick
from lakeweave.llm.html_pages import NAMES, made_pages
from lakeweave.llm.trees import Forest, fit_forest

# The elements of HTML that start a block of their own, those whose content
# is no text of the page, and those that end at the next of their kind.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template textarea title select button iframe object svg canvas video audio noframes xmp datalist".split())
#: Those whose content is no markup: without an end they take the rest of the page.
RAW = frozenset("script style textarea title iframe xmp noframes".split())
ENDS_P = BLOCKS - frozenset("html body caption legend summary tbody td tfoot th thead tr dd dt li".split()) | {"li", "dd", "dt"}
SELF_CLOSED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
SPACED = frozenset("br wbr img input hr".split())

_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>)""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SOME_SKIPPED = re.compile("<(?:" + "|".join(sorted(SKIPPED - RAW)) + r")[\s/>]", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+|\d+")
_CLOSE = {tag: re.compile(f"</{tag}[\\s/>]", re.IGNORECASE) for tag in RAW}
_EMPTY = re.compile(r"(?:^|[\s\"']|=[\"'][^\"']*[\"'])/$")


def _after_raw(source: str, name: str, at: int) -> int:
    """Where the content and the end tag of a raw element end."""
    end = _CLOSE[name].search(source, at)
    close = -1 if end is None else source.find(">", end.start())
    return len(source) if close < 0 else close + 1


def skipped_to(source: str) -> dict[int, int]:
    """Where each element of SKIPPED ends that is no raw one, by the end of its start tag.

    An empty svg ends at once. One without an end tag before its block ends has no
    entry. A button or select ends where the next one starts.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held = dict.fromkeys(BLOCKS | SKIPPED, 0)

    def back_to(name: str) -> int:
        while True:
            last, at = stack.pop()
            held[last] -= 1
            if last == name:
                return at

    at = 0
    while (m := _TOKEN.search(source, at)) is not None:
        at = m.end()
        if (name := m[1]) is not None:
            name = name.lower()
            empty = _EMPTY.search(m[2]) is not None
            if name in RAW:
                if not (empty and held["svg"]):
                    at = _after_raw(source, name, at)
            elif name == "svg" and empty:
                ends[at] = at
            elif name in SKIPPED:
                if name in ("button", "select") and held[name]:
                    back_to(name)
                stack.append((name, at))
                held[name] += 1
            elif name in BLOCKS and name not in ("html", "body", "hr"):
                stack.append((name, at))
                held[name] += 1
        elif (name := m[3]) is not None and held.get(name := name.lower(), 0):
            start = back_to(name)
            if name in SKIPPED:
                ends[start] = at
    return ends

_TAGS = {t: i for i, group in enumerate(("article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dd dt", "table tbody thead tfoot tr", "td th", "nav", "header", "footer", "aside", "form fieldset", "blockquote pre", "figure figcaption", "html body")) for t in group.split()}
_N_TAGS = 19
_GROUPS = [g for g in NAMES if g != "neutral"]
_NAME_GROUP: dict[str, int] = {}
for _g in _GROUPS:
    for _n in NAMES[_g]:
        for _p in (_n, *_n.split("-")):
            if _p == _n or _g != "main":
                _NAME_GROUP.setdefault(_p, _GROUPS.index(_g))
#: Elements that say by themselves what their content is.
_CLEAR = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "article": 0, "main": 0}


class Page:
    """Nodes in page order, the root first, and runs of text (node, text) between block boundaries."""

    def __init__(self, source: str):
        self.tag, self.up, self.names, self.label = ["html"], [-1], [()], [0]
        self.kids = [0]
        self.runs: list[tuple[int, str]] = []
        self.chars, self.linked, self.words, self.marks = [0], [0], [0], [0]
        self._read(source)

    def _flush(self, node: int, parts: list[str], links: int) -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.runs.append((node, text))
                self.chars[node] += len(text)
                self.linked[node] += min(links, len(text))
                self.words[node] += text.count(" ") + 1
                self.marks[node] += text.count(".") + text.count(",")

    def _read(self, source: str) -> None:
        stack, parts, in_link, links, at = [0], [], False, 0, 0
        search, tags = _TOKEN.search, self.tag
        ends, passing = skipped_to(source) if _SOME_SKIPPED.search(source) else {}, False
        while (m := search(source, at)) is not None:
            if m.start() > at:
                text = source[at : m.start()]
                if "&" in text:
                    text = html.unescape(text)
                if not passing:
                    parts.append(text)
                    links += len(text) if in_link else 0
            at = m.end()
            if (name := m[1]) is not None:
                name = name.lower()
                if name in RAW:
                    at = _after_raw(source, name, at)
                elif name in SKIPPED:
                    # without an end, it has the text up to the next block
                    passing = passing or at not in ends
                    at = ends.get(at, at)
                elif name == "a":
                    in_link = True
                elif name in BLOCKS:
                    passing = False
                    self._flush(stack[-1], parts, links)
                    links, in_link = 0, False
                    self._open(name, m[2], stack)
                elif name in SPACED:
                    parts.append(" ")
            elif (name := m[3]) is not None:
                name = name.lower()
                if name == "a":
                    in_link = False
                elif name in BLOCKS and name not in ("html", "body"):
                    passing = False
                    self._flush(stack[-1], parts, links)
                    links, in_link = 0, False
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == name:
                            del stack[k:]
                            break
        if at < len(source) and not passing:
            parts.append(html.unescape(source[at:]))
        self._flush(stack[-1], parts, links)

    def _open(self, name: str, attrs: str, stack: list[int]) -> None:
        tags = self.tag
        if name in ("html", "body") and name in (tags[k] for k in stack):
            return
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == "p":
                    del stack[k:]
                    break
                if tags[stack[k]] in ("table", "td", "th", "caption"):
                    break
        if name in SELF_CLOSED:
            ends, within = SELF_CLOSED[name]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in within and tags[stack[k]] not in ends:
                    break
                if tags[stack[k]] in ends:
                    del stack[k:]
        node, above = len(tags), stack[-1]
        names, label = [], 0
        if attrs:
            for key, a, b, c in _NAMED.findall(attrs):
                value = a or b or c
                if key.lower() == "data-main":
                    label = int(value == "1")
                else:
                    for whole in value.lower().replace("_", "-").split():
                        names.append(whole)
                        if not whole.isalpha():
                            names += _PART.findall(whole)
        tags.append(name)
        self.up.append(above)
        self.names.append(tuple(names))
        self.label.append(label)
        self.kids.append(0)
        self.kids[above] += 1
        for sums in (self.chars, self.linked, self.words, self.marks):
            sums.append(0)
        if name != "hr":
            stack.append(node)

    def features(self) -> list[list[float]]:
        """A row for each node; children stand after their parents."""
        n = len(self.tag)
        chars, linked, words, marks = self.chars[:], self.linked[:], self.words[:], self.marks[:]
        nodes, paras = [1] * n, [int(t == "p") for t in self.tag]
        for i in range(n - 1, 0, -1):
            u = self.up[i]
            chars[u] += chars[i]
            linked[u] += linked[i]
            words[u] += words[i]
            marks[u] += marks[i]
            nodes[u] += nodes[i]
            paras[u] += paras[i]
        total = max(1, chars[0])
        depth, place = [0] * n, [0] * n
        within: list[tuple] = [()] * n  # for each group of names and clear elements: steps up to the nearest, or 9
        rows, seen = [], [0] * n
        none = (9.0,) * (len(_GROUPS) + 6)
        for i in range(n):
            u = self.up[i]
            if u >= 0:
                depth[i], place[i] = depth[u] + 1, seen[u]
                seen[u] += 1
                near = [min(9.0, x + 1) for x in within[u]]
            else:
                near = list(none)
            own = 0
            for name in self.names[i]:
                if (g := _NAME_GROUP.get(name)) is not None:
                    near[g] = 0.0
                    own = 1
            if (g := _CLEAR.get(self.tag[i])) is not None:
                near[len(_GROUPS) + g] = 0.0
            within[i] = tuple(near)
            kin = self.kids[u] if u >= 0 else 1
            row = [0.0] * _N_TAGS
            row[_TAGS.get(self.tag[i], _N_TAGS - 1)] = 1.0
            size = max(1, chars[i])
            row += near
            row += [own, depth[i], place[i], place[i] / kin, kin, self.kids[i], chars[i], chars[i] / total, linked[i] / size, words[i] / nodes[i], marks[i] / max(1, words[i]), paras[i], nodes[i], chars[u] / total if u >= 0 else 1.0, linked[u] / max(1, chars[u]) if u >= 0 else 0.0, paras[u] if u >= 0 else 0.0]
            rows.append(row)
        return rows

    def decode(self, p: np.ndarray) -> list[bool]:
        """Whether each node is main text, by the likeliest labels that agree along all paths."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
        outside, inside, foreign = no[:], yes[:], no[:]  # best sums below each node, by its label
        for i in range(n - 1, 0, -1):
            u = self.up[i]
            outside[u] += max(outside[i], inside[i])
            inside[u] += max(inside[i], foreign[i])
            foreign[u] += foreign[i]
        state = [0] * n
        state[0] = 1 if inside[0] > outside[0] else 0
        for i in range(1, n):
            s = state[self.up[i]]
            state[i] = (1 if inside[i] > outside[i] else 0) if s == 0 else (1 if inside[i] >= foreign[i] else 2) if s == 1 else 2
        return [s == 1 for s in state]


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 1) -> Forest:
    """Trees fitted to made-up pages; a fixed number, so a fixed cost."""
    x, y = [], []
    for source in made_pages(pages, seed):
        page = Page(source)
        x += page.features()
        y += page.label
    return fit_forest(np.array(x, float), np.array(y, float), trees=60, depth=5, rate=0.2)


def main_texts(sources: list[str], forest: Forest) -> list[str]:
    """The main text of each page; the nodes of all of them go through the trees together."""
    pages = [Page(s) for s in sources]
    rows = [page.features() for page in pages]
    scores = forest.score(np.array([r for page in rows for r in page], float)) if pages else []
    out, at = [], 0
    for page, its in zip(pages, rows, strict=True):
        kept = page.decode(scores[at : at + len(its)])
        at += len(its)
        out.append("\n".join(text for node, text in page.runs if kept[node]))
    return out


def extract_text(pages: DataFrame, at_once: int = 128) -> DataFrame:
    """The main text of each row of pages (page_id, url, html).

    Returns page_id, url, text and n_chars (code points). Character references are decoded;
    white space inside a block becomes one space; blocks follow in page order, joined by a
    line feed. Buttons, selections, graphics, media and what stands in for scripts are no text;
    formulas are. A null or empty page, and one without main text, gives an empty text. Each
    input row gives one row; equal pages give equal texts; further columns are ignored.
    """
    rows = pick(pages, "page_id", "url", "html")
    shared = rows.sparkSession.sparkContext.broadcast(trained())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return arrow_map(rows.select("page_id", "url", F.col("html").cast("string")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")

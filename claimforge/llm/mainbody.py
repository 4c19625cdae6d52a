"""Problem 1: the main body of web pages, by a decision tree over flat text blocks.

A page is a flat sequence of text blocks (the non-blank lines of its visible text). Each block has its word count and link
density, those of its neighbours and of its container, its tag and place, and how much its words speak for furniture
(log odds over the labelled table). One CART tree, trained on a small labelled table, decides furniture or main body.

The labelled table: the invented pages of ``blocks_seed`` and at most LABELLED_PAGES pages of the corpus, of at most LABELLED_CHARS
characters and PER_HOST of a host, whose markup names its regions (<main>, or a single <article>, against the rest), taken in the order of a hash of page_id. Each enters in several copies, with the region names,
the containers or all markup hidden, so that the tree learns pages without them; words are scored out of fold.

Results at the edges: null, '' and blank texts have no blocks; blank lines are never furniture; html null or out of step with the text
leaves the markup's features unknown (-1); repeated rows come out repeatedly; with an empty corpus the seed pages alone train the tree.
"""

from __future__ import annotations

import html as html_module
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimforge.llm import blocks_seed
from claimforge.llm.common import host_of
from claimforge.session import widened

#: Most pages of the corpus in the labelled table.
LABELLED_PAGES = 800
DEPTH, LEAF = 14, 4
#: Most pages of one host among them, so that a hot host does not fill the table.
PER_HOST = 15
#: Longest page, in characters of text and html together, that enters the labelled table: bounds what is sent to the driver.
LABELLED_CHARS = 200_000
#: Pages whose blocks are put through the tree together.
CHUNK = 500

TOKEN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
HIDDEN = {"script", "style", "noscript", "template", "head", "title"}
INLINE = {"a", "b", "i", "em", "strong", "span", "small", "sup", "sub", "u", "abbr", "code", "time", "img", "mark", "q", "cite", "font", "label", "input", "button"}
CONTAINERS = {"nav", "main", "article", "aside", "footer", "header", "section", "div", "td", "form", "body", "ul", "ol", "table"}
REGIONS = {"nav": 0, "aside": 0, "footer": 0, "header": 0, "main": 1, "article": 1}
TAGS = {"p": 1, "li": 2, "h1": 3, "h2": 4, "h3": 5, "h4": 5, "h5": 5, "h6": 5, "div": 6, "blockquote": 7, "td": 8, "span": 6}

ENDS = ".!?。！？…;\"”»"
WIDE = re.compile(r"[぀-ヿ一-鿿가-힯]")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")


class Block:
    __slots__ = ("text", "linked", "tag", "region", "chain")

    def __init__(self, text, linked, tag, region, chain):
        self.text, self.linked, self.tag, self.region, self.chain = text, linked, tag, region, chain


def markup_blocks(source: str) -> list[Block]:
    """The text blocks of an HTML page, without building a tree."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    hidden = ""
    tag = "p"
    stack: list[tuple[str, int]] = [("body", 0)]
    serial = 0

    def flush():
        nonlocal linked
        text = "".join(parts)
        if "&" in text:
            text = html_module.unescape(text)
        text = " ".join(text.split())
        if text:
            region = next((REGIONS[t] for t, _ in reversed(stack) if t in REGIONS), -1)
            out.append(Block(text, min(1.0, linked / len(text)), tag, region, tuple(i for _, i in stack)))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(source):
        closing, name, text = m[1], m[2], m[4]
        if text is not None:
            if not hidden:
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        if hidden:
            if closing and name == hidden:
                hidden = ""
            continue
        if name in HIDDEN and not closing:
            hidden = name
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        flush()
        in_link = 0
        if name in CONTAINERS:
            if closing:
                if any(t == name for t, _ in stack[1:]):
                    while stack[-1][0] != name:
                        stack.pop()
                    stack.pop()
            elif name != "body":
                serial += 1
                stack.append((name, serial))
        if not closing:
            tag = name
    flush()
    return out


def align(lines: list[tuple[int, str]], blocks: list[Block]) -> list[Block | None]:
    """The block of each line by a longest common subsequence of the whole page; None where the markup has no such text.

    A last line that the text cuts short takes the first block after the others that begins with it.
    """
    texts = [x for _, x in lines]
    head = 0
    while head < min(len(texts), len(blocks)) and texts[head] == blocks[head].text:
        head += 1
    out: list[Block | None] = [*blocks[:head], *[None] * (len(texts) - head)]
    after = head
    if head < len(texts):
        places: dict[str, list[int]] = {}
        for j in range(len(blocks) - 1, head - 1, -1):
            places.setdefault(blocks[j].text, []).append(j)
        # tails[k]: the least block at which a common subsequence of k + 1 lines can end; links lead back along it.
        tails: list[int] = []
        ends: list[tuple] = []
        for i in range(head, len(texts)):
            for j in places.get(texts[i], ()):
                k = bisect_left(tails, j)
                link = (i, j, ends[k - 1] if k else None)
                if k == len(tails):
                    tails.append(j), ends.append(link)
                else:
                    tails[k], ends[k] = j, link
        link = ends[-1] if ends else None
        after = link[1] + 1 if link else head
        while link:
            out[link[0]] = blocks[link[1]]
            link = link[2]
        if out[-1] is None:
            out[-1] = next((b for b in blocks[after:] if b.text.startswith(texts[-1])), None)
    return out


def terms(line: str) -> list[str]:
    """Words in lower case, pairs of characters where no spaces part words, and the line as a whole."""
    low = line.lower()
    words = WORD.findall(low)
    if low.isascii():
        words.append("=" + " ".join(words))
        return words
    found, words = words, []
    for w in found:
        if WIDE.search(w):
            words += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            words.append(w)
    words.append("=" + " ".join(found))
    return words


FEATURES = (
    "words", "chars", "density", "tag", "region", "ends", "marks", "digits", "odds", "odds_max", "place", "from_end", "before_long", "after_long",
    "c_blocks", "c_words", "c_longest", "c_density", "c_odds", "c_first", "page_blocks", "title_like", "copyright",
    *(f"{name}_{d}" for d in (-2, -1, 1, 2) for name in ("words", "density", "odds", "ends", "tag")),
)
LONG = 14


def _size(line: str) -> float:
    """Words; where no spaces part words, two characters count as one."""
    if line.isascii() or not (wide := len(WIDE.findall(line))):
        return line.count(" ") + 1
    return len(WIDE.sub(" ", line).split()) + wide / 2


Page = tuple[list[str], list[Block | None]]


def _line(line: str, scores: dict[str, float]) -> tuple[float, ...]:
    """What a line says on its own: words, chars, ends, marks, digits, odds, strongest odds, title-like, copyright."""
    n = len(line)
    got = [scores[t] for t in terms(line) if t in scores]
    ends = line[-1] in ENDS
    marks = line.count("|") + line.count(">") + line.count("/") + line.count("»") + line.count("·")
    digits = len(DIGIT.findall(line)) / n
    return (_size(line), n, ends, marks, digits, sum(got) / len(got) if got else 0.0, max(got, key=abs) if got else 0.0, not ends and (line[0].isupper() or bool(WIDE.match(line))), "©" in line or "(c)" in line.lower())


def _outer(values: np.ndarray, group: np.ndarray, n: int, how, start: float) -> np.ndarray:
    out = np.full(n, start)
    how.at(out, group, values)
    return out


def features(pages: list[Page], scores: dict[str, float], hide: str = "", memory: dict | None = None) -> np.ndarray:
    """One row per line of the pages. hide: '' (nothing), 'region', 'container' or 'markup'; memory: lines seen before."""
    memory = {} if memory is None else memory
    own: list[tuple[float, ...]] = []
    page_of: list[int] = []
    markup: list[tuple[float, float, float, int]] = []
    unknown = (-1.0, -1.0, -1.0, -1)
    groups = 0
    for k, (lines, blocks) in enumerate(pages):
        for x in lines:
            got = memory.get(x)
            if got is None:
                got = _line(x, scores)
                if len(x) < 60 and len(memory) < 100_000:
                    memory[x] = got
            own.append(got)
        page_of += [k] * len(lines)
        if hide == "markup":
            markup += [unknown] * len(lines)
            continue
        held: dict[int, int] = {}
        here = 0
        for b in blocks:
            if b is not None:
                here += 1
                for c in b.chain:
                    held[c] = held.get(c, 0) + 1
        ids: dict[int, int] = {}
        for b in blocks:
            if b is None:
                markup.append(unknown)
                continue
            # The container of a block is its innermost ancestor that holds more than this block; one that holds the whole page says nothing.
            home = next((c for c in reversed(b.chain) if held[c] >= 2), 0)
            if held[home] == here:
                markup.append((b.linked, TAGS.get(b.tag, 0), b.region, -1))
                continue
            if home not in ids:
                ids[home] = groups
                groups += 1
            markup.append((b.linked, TAGS.get(b.tag, 0), b.region, ids[home]))
    base = np.array(own, float).reshape(-1, 9)
    words, chars, ends, marks, digits, odds, odds_max, title, copyright_ = base.T
    marked = np.array(markup, float).reshape(-1, 4)
    density, tag, region, group = marked[:, 0], marked[:, 1], marked[:, 2], marked[:, 3].astype(np.int64)
    if hide:
        region = np.full(len(words), -1.0)
    if hide == "container":
        tag = np.where((tag == -1) | (tag == 3), tag, 6.0)
        group = np.full(len(words), -1)
    page = np.array(page_of, np.int64)
    total = len(pages)
    sizes = np.bincount(page, minlength=total)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(page)) - first[page]
    n = sizes[page]
    long = (words >= LONG) & (ends > 0)
    none = 1 << 30
    low = _outer(at[long], page[long], total, np.minimum, none)[page]
    high = _outer(at[long], page[long], total, np.maximum, -none)[page]
    before = np.where(low == none, 99, np.clip(low - at, -30, 30))
    after = np.where(high == -none, 99, np.clip(at - high, -30, 30))
    stats = np.full((len(page), 6), -1.0)
    inside = group >= 0
    if inside.any():
        g, w = group[inside], words[inside]
        count = np.bincount(g, minlength=groups)
        sums = np.bincount(g, w, groups)
        stats[inside, 0], stats[inside, 1] = count[g], sums[g]
        stats[inside, 2] = _outer(w, g, groups, np.maximum, 0.0)[g]
        stats[inside, 3] = np.bincount(g, w * density[inside], groups)[g] / np.maximum(1.0, sums[g])
        stats[inside, 4] = np.bincount(g, odds[inside], groups)[g] / count[g]
        order = np.argsort(g, kind="stable")
        rank = np.empty(len(g))
        rank[order] = np.arange(len(g)) - (np.cumsum(count) - count)[g[order]]
        stats[inside, 5] = rank
    cols = [words, chars, density, tag, region, ends, marks, digits, odds, odds_max, at / np.maximum(1, n - 1), n - 1.0 - at, before, after, *stats.T, n.astype(float), title, copyright_]
    for d in (-2, -1, 1, 2):
        near = np.clip(np.arange(len(page)) + d, 0, len(page) - 1)
        valid = (at + d >= 0) & (at + d < n)
        for source, fallback in ((words, -1.0), (density, -2.0), (odds, 0.0), (ends, -1.0), (tag, -2.0)):
            cols.append(np.where(valid, source[near], fallback))
    return np.column_stack(cols)


class Tree:
    """A binary classification tree: grown by Gini impurity, kept as flat arrays, applied level by level."""

    def __init__(self, depth: int = DEPTH, leaf: int = LEAF):
        self.depth, self.leaf = depth, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        feature, cut, child, value = [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1), cut.append(0.0), child.append((0, 0)), value.append(float(y[rows].mean()) if len(rows) else 0.0)
            n, ones = len(rows), y[rows].sum()
            if depth == 0 or n < 2 * self.leaf or ones in (0, n):
                return me
            best = (1e-7, -1, 0.0)
            whole = 2 * (ones / n) * (1 - ones / n)
            for f in range(x.shape[1]):
                v = x[rows, f]
                order = np.argsort(v, kind="stable")
                v, c = v[order], np.cumsum(y[rows][order])
                left = np.arange(1, n)
                ok = (v[1:] > v[:-1]) & (left >= self.leaf) & (n - left >= self.leaf)
                if not ok.any():
                    continue
                pl, pr = c[:-1] / left, (ones - c[:-1]) / (n - left)
                gain = np.where(ok, whole - (left * 2 * pl * (1 - pl) + (n - left) * 2 * pr * (1 - pr)) / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[k] + v[k + 1]) / 2)
            if best[1] < 0:
                return me
            goes = x[rows, best[1]] <= best[2]
            feature[me], cut[me] = best[1], best[2]
            child[me] = (grow(rows[goes], depth - 1), grow(rows[~goes], depth - 1))
            return me

        grow(np.arange(len(y)), self.depth)
        self.feature, self.cut, self.child, self.value = np.array(feature), np.array(cut), np.array(child), np.array(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[row, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, self.child[node, right.astype(int)], node)
        return self.value[node]


class Model:
    def __init__(self, tree: Tree, scores: dict[str, float]):
        self.tree, self.scores = tree, scores
        self.memory: dict = {}

    def __getstate__(self):
        return {"tree": self.tree, "scores": self.scores, "memory": {}}

    def furniture(self, rows: list[tuple[str | None, str | None]]) -> list[list[int]]:
        """Of each (text, html): the numbers of the lines of text that are outside the main body."""
        numbers, pages = [], []
        for text, html in rows:
            lines = split_lines(text)
            numbers.append([n for n, _ in lines])
            pages.append(([x for _, x in lines], align(lines, markup_blocks(html)) if html and lines else [None] * len(lines)))
        if not any(numbers):
            return numbers
        chance = self.tree.predict(features(pages, self.scores, memory=self.memory))
        out, at = [], 0
        for own in numbers:
            out.append([n for n, p in zip(own, chance[at : at + len(own)]) if p > 0.5])
            at += len(own)
        return out


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(number, text) of the non-blank lines, white space made one space."""
    return [(n, s) for n, x in enumerate((text or "").split("\n")) if (s := " ".join(x.split()))]


def _odds(pages: list[tuple[list[str], list[int]]]) -> dict[str, float]:
    """Log odds of furniture of every term on at least two pages."""
    seen = ({}, {})
    pages_of: Counter = Counter()
    for lines, labels in pages:
        mine: set = set()
        for line, label in zip(lines, labels):
            for t in set(terms(line)):
                seen[label][t] = seen[label].get(t, 0) + 1
                mine.add(t)
        pages_of.update(mine)
    return {t: float(np.log((seen[1].get(t, 0) + 0.5) / (seen[0].get(t, 0) + 0.5))) for t, n in pages_of.items() if n >= 2}


def seed_pages() -> list[tuple[list[str], list[Block | None], list[int]]]:
    out = []
    for page in blocks_seed.PAGES.strip().split("\n\n"):
        lines, blocks, labels = [], [], []
        for row in page.split("\n"):
            label, text = int(row[0] == "-"), row[1:]
            link = text.startswith("@")
            text = text.lstrip("@")
            lines.append(text), labels.append(label)
            blocks.append(Block(text, float(link), "li" if link else "p", -1, (0, 1 if label == 0 else 2 + (len(lines) > 6))))
        out.append((lines, blocks, labels))
    return out


def labelled_pages(rows: list[tuple[str, str]]) -> list[tuple[list[str], list[Block | None], list[int]]]:
    """Labels of pages (text, html) whose markup names the main region."""
    out = []
    for text, html in rows:
        lines = split_lines(text)
        blocks = align(lines, markup_blocks(html))
        if lines and all(b is not None for b in blocks) and any(b.region == 1 for b in blocks):
            out.append(([x for _, x in lines], blocks, [int(b.region != 1) for b in blocks]))
    return out


def train(rows: list[tuple[str, str]]) -> Model:
    seed = seed_pages()
    pages = [*seed * 2, *labelled_pages(rows)]
    folds = 5
    x, y = [], []
    for k in range(folds):
        scores = _odds([(p[0], p[2]) for i, p in enumerate(pages) if i % folds != k])
        mine = pages[k::folds]
        for hide in ("", "region", "container", "markup"):
            x.append(features([p[:2] for p in mine], scores, hide))
            y += [label for p in mine for label in p[2]]
    return Model(Tree().fit(np.vstack(x), np.array(y, float)), _odds([(p[0], p[2]) for p in pages]))


def fit(pages: DataFrame, most: int = LABELLED_PAGES, chars: int = LABELLED_CHARS) -> Model:
    """The model, trained on the driver from the bounded labelled table. Runs two jobs over the pages when called."""
    pages = pages.filter((F.contains("html", F.lit("<main")) | (F.regexp_count("html", F.lit("<article")) == 1)) & (F.length("html") + F.length("text") <= chars))
    named = pages.filter(F.col("final_url").isNotNull())
    per_host = W.partitionBy("host").orderBy(F.xxhash64("page_id"), "page_id")
    ranked = named.select("page_id", host_of(F.col("final_url")).alias("host")).withColumn("rank", F.row_number().over(per_host)).filter(F.col("rank") <= PER_HOST)
    chosen = [r.page_id for r in ranked.orderBy("rank", F.xxhash64("page_id"), "page_id").limit(most).collect()]
    rows = pages.filter(F.col("page_id").isin(chosen)).select("page_id", "text", "html").orderBy("page_id").limit(2 * most).collect() if chosen else []
    return train([(r.text, r.html) for r in rows if r.html])


def furniture_lines(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, line_no): every line outside the main body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = [], []
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for at in range(0, len(rows), CHUNK):
                for i, found in zip(batch.column(0)[at : at + CHUNK].to_pylist(), model.furniture(rows[at : at + CHUNK])):
                    ids += [i] * len(found)
                    numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])

    return widened(pages.select(F.col("page_id").cast("bigint"), "text", "html")).mapInArrow(run, "page_id bigint, line_no int")


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, main): the main body of every page, null where text is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for at in range(0, len(rows), CHUNK):
                for (text, _), found in zip(rows[at : at + CHUNK], model.furniture(rows[at : at + CHUNK])):
                    gone = set(found)
                    kept.append(None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["page_id", "main"])

    return widened(pages.select(F.col("page_id").cast("bigint"), "text", "html")).mapInArrow(run, "page_id bigint, main string")

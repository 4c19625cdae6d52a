"""Problem 7: template residue and error-page text, by SimHash and label propagation.

Units are the lines of pages.text in a normal form (lower case, numbers as 0, every unfilled placeholder as one
token, dummy Latin as one token, incident numbers and paths cut off), and what a separator (" - ", " | ") leaves of them, so that "Firm - Page not
found" has the unit "page not found". Equal units are one node. Nodes whose 64-bit SimHashes differ in at most REACH bits and whose shingle sets
have a Jaccard of at least SIMILARITY (character 4-grams of short units, five-word shingles of units of LONG words or more) are linked.

The trusted labels of ``residue_seed`` (residue, or speaking about it) spread through the links until nothing changes: a connected
component that holds a trusted line has its label. Each round compares the newly labelled nodes, the frontier, with the hashes of all nodes whose shingle sets
are of a fitting size; REACH is so wide that the exact Jaccard decides (tables keyed by bit blocks find hashes within a few bits only and would lose most pairs).
Only labels spread, so links between unlabelled nodes are never made, and a line that a third of all pages have is one node. A page is residue if a line has a residue unit and none that speaks about it.

Dummy Latin: the words of lines that hold three or more words of the well-known text, kept if such lines are where they mostly stand.

Results at the edges: null, '' and blank texts are no cases; repeated rows are one page_id each; a text of any length is taken whole; an empty
table gives an empty result; with no residue at all the result is empty.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm import residue_seed
from claimforge.llm.common import checkpointed, written
from claimforge.session import widened

#: HAMMING is the radius of copies but for a slip, and what spread takes unless told otherwise; the query asks for REACH.
HAMMING, SIMILARITY, LONG = 3, 0.8, 12
#: At a Jaccard of 0.8 a bit of two SimHashes differs with probability 0.15 (arccos(2 * 0.8 / 1.8) / pi), 0.19 for sets of four and five shingles. Of 64 bits
#: more than 26 then differ in two of ten million pairs, 13 of a million of the tiny sets; so the Jaccard decides, and the hashes only spare its computation.
REACH = 26
#: Rows of a frontier that go to the partitions at once, and rows up to which the labelled nodes are broadcast.
BROADCAST_ROWS = 20_000
PAIRS_AT_ONCE = 2_000_000
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = list(itertools.combinations(BLOCKS, 2))
#: A word of dummy Latin stands on at least this share of the lines found by the well-known words: bounds the list.
FILLER_SHARE = 0.01

SLOT, FILL, VOID, TALKS = "⟦slot⟧", "⟦fill⟧", "⟦void⟧", "⟦talk⟧"
# The well-known dummy text.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat "
    "duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum vestibulum curabitur pellentesque maecenas".split()
) - {"do", "et", "sit", "dolor", "magna", "esse", "dolore"} | {"sit", "dolor"}
CORE = {"lorem", "ipsum", "dolor", "amet", "sit", "consectetur", "adipiscing", "elit", "eiusmod", "incididunt", "aliqua", "nostrud", "ullamco", "voluptate"}
SLOTS = re.compile(
    r"\{\{[^{}\n]+\}\}|\[\[[^\[\]\n]+\]\]|\{%[^%\n]+%\}|%%[^%\s]+%%|@@[^@\s]+@@|[$#]\{[^{}\n]+\}|\{\$[^{}\n]+\}|<%=?[^%\n]+%>|(?<!\w)__[A-Za-z]\w*(?:\.\w+)*?__(?!\w)"
    r"|(?<![\w$#{])\{[A-Za-z][A-Za-z0-9_.]*\}(?!\})|<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>|(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?!\w)|<\?(?:php|=)[^?\n]+\?>"
    r"|[\[<(](?:(?:enter|insert|add|your|type|company name|name|hier)\b[^\[\]<>()\n]*|[^\[\]<>()\n]*\b(?:eintragen|eingeben|einfügen|einsetzen|here|ici|aquí|à saisir|à compléter|a completar|вставить|ввести|を入力))[\]>)]",
    re.I,
)
SLOT_CASE = re.compile(r"^<[a-z]|^\{[a-z]+\}$|^%[a-z]")
META = re.compile(r"\b(?:templates?|placeholders?|variables?|merge fields?|curly|braces|syntax|vorlagen?|platzhalter|gabarits?|modèles?|plantillas?|marcador|шаблон\w*|πρότυπ\w*)\b|テンプレート|プレースホルダ", re.I)
LEAK = re.compile(r"\bundefined\b|\bnull\b|\bNaN\b|\bNone\b|\[object object\]", re.I)
TAIL = re.compile(r"\s*(?:[\[(](?=[^\[\]()]*[\d/#:.])[^\[\]()]*[\])]|\bincident [0-9a-f]+\.?|\bref(?:erence)?\.? ?:?[0-9a-f]{4,}|(?<=[\s.])/[\w./-]+)\s*$", re.I)
PARTS = re.compile(r"\s+[-–—|·»]\s+|(?<=\w):\s+")
WORD = re.compile(r"[^\W\d_]+")


SIGNS = dict.fromkeys(map(ord, "\"'“”„«».!?…,;:。！？、()[]*"), " ")
ASCII_SIGNS = bytes(32 if c in SIGNS else c for c in range(256))
NUMBER = re.compile(r"\d[\d.,]*")


def _ends_in_a_tail(text: str, low: str) -> bool:
    """Whether TAIL may match: each of its forms implies one of these."""
    end = text.rstrip()
    return end[-1:] in ("]", ")") or "/" in end[end.rfind(" ") + 1 :] or "ref" in low or "dent" in low


def normal(line: str, filler: frozenset[str]) -> str:
    """The normal form of a line."""
    text, low = line, line.lower()
    # Each form of LEAK and of SLOTS implies one of these.
    if "null" in low or "nan" in low or "none" in low or "undef" in low or "[ob" in low:
        text = LEAK.sub(VOID, text)
    if "{" in text or "[" in text or "<" in text or "%" in text or "@" in text or "_" in text or "#" in text or "$" in text or "(" in text:
        text = SLOTS.sub(lambda m: m[0] if SLOT_CASE.match(m[0]) else SLOT, text)
    while _ends_in_a_tail(text, low):
        text, n = TAIL.subn("", text)
        if not n:
            break
    if text is not line:
        low = text.lower()
    words = WORD.findall(low)
    if len(words) >= 4 and sum(map(filler.__contains__, words)) >= 0.6 * len(words):
        return FILL
    low = NUMBER.sub("0", low)
    if low.isascii():
        return " ".join(low.encode().translate(ASCII_SIGNS).decode().split())
    return " ".join(low.translate(SIGNS).split())


def units(line: str, filler: frozenset[str]) -> set[str]:
    """The units of a line: the whole, what stands before, between and after separators, and its placeholders."""
    whole = normal(line, filler)
    out = {whole}
    # Each separator holds one of these.
    if ":" in line or "-" in line or "–" in line or "—" in line or "|" in line or "·" in line or "»" in line:
        cuts = [m.span() for m in PARTS.finditer(line)]
        if cuts:
            begins, ends = [0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(line)]
            spans = {*zip(begins, ends), (begins[1], len(line)), (0, ends[-2])}
            out.update(normal(line[b:e], filler) for b, e in spans)
    if SLOT in whole:
        out.add(SLOT)
        if META.search(line):
            out.add(TALKS)
    out.discard("")
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_word_codes: dict[str, int] = {}


def _word_code(w: str) -> int:
    code = _word_codes.get(w)
    if code is None:
        import xxhash

        code = xxhash.xxh64_intdigest(w)
        if len(_word_codes) > 500_000:
            _word_codes.clear()
        _word_codes[w] = code
    return code


def simhash(texts: list[str]) -> np.ndarray:
    """The 64-bit SimHash of each text, as signed integers."""
    codes, sizes, widths = [], [], []
    for t in texts:
        words = t.split()
        if len(words) >= LONG:
            codes.append(np.fromiter(map(_word_code, words), np.uint64, len(words)))
            widths.append(5)
        else:
            padded = f"^{t}$"
            codes.append(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
            widths.append(min(4, len(padded)))
        sizes.append(len(codes[-1]))
    if not texts:
        return np.zeros(0, np.int64)
    flat, size, width = np.concatenate(codes), np.array(sizes), np.array(widths)
    begins = np.cumsum(size) - size
    count = size - width + 1
    own = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begins[own]
    h = np.full(len(place), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(5):
        inside = width[own] > k
        step = flat[np.minimum(place + k, len(flat) - 1)]
        h = np.where(inside, _mix((h + step + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)), h)
    out = np.zeros(len(texts), np.uint64)
    starts = np.cumsum(count) - count
    for a in range(0, len(texts), 2000):
        b = min(len(texts), a + 2000)
        lo, hi = starts[a], starts[b - 1] + count[b - 1]
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[a:b] - lo, axis=0, dtype=np.int32)
        kept = (2 * ones > count[a:b, None]).astype(np.uint8)
        out[a:b] = np.packbits(kept, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def table_keys(sim: Column) -> Column:
    """The ten keys of a hash: two of its five blocks, with the number of the table: hashes within HAMMING bits agree on one; too few for SIMILARITY."""
    keys = []
    for n, ((a, p), (b, q)) in enumerate(PAIRS):
        left = F.shiftrightunsigned(sim, a).bitwiseAND(F.lit((1 << p) - 1))
        right = F.shiftrightunsigned(sim, b).bitwiseAND(F.lit((1 << q) - 1))
        keys.append(left * F.lit(1 << 13) + right + F.lit(n << 26))
    return F.array(*keys)


def _word_counts(pages: DataFrame, words: frozenset[str], least: int, all_words: bool) -> DataFrame:
    """(w, n): on how many lines with at least so many of the words each of their words stands, or each of the given words only; '#' counts these lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                low = text.lower()
                # What a line holds, its page holds.
                here = [w for w in words if w in low]
                if len(here) < least:
                    continue
                for line in low.split("\n"):
                    if sum(w in line for w in here) >= least:
                        own = set(WORD.findall(line))
                        met = own & words
                        if len(met) >= least:
                            count.update(own if all_words else met)
                            count["#"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["w", "n"])

    counts = widened(pages.filter(F.col("text").isNotNull()).select("text")).mapInArrow(run, "w string, n bigint")
    return counts.groupBy("w").agg(F.sum("n").alias("n"))


def filler_words(pages: DataFrame) -> frozenset[str]:
    """The words of dummy Latin in the corpus; at most (words of a line) / FILLER_SHARE of them."""
    words = checkpointed(_word_counts(pages, frozenset(CORE), 3, True))
    every = words.filter("w = '#'").agg(F.max("n")).first()[0] or 0
    counted = {r.w: r.n for r in words.filter(F.col("n") >= max(3, FILLER_SHARE * every)).collect()}
    new = frozenset(w for w in counted if len(w) >= 2 and w not in LATIN)
    if not new:
        return frozenset(LATIN)
    found = _word_counts(pages, new, 1, False).collect()
    return frozenset(LATIN | {r.w for r in found if counted.get(r.w, 0) >= 0.3 * r.n and r.w != "#"})


def page_units(pages: DataFrame, filler: frozenset[str]) -> DataFrame:
    """(page_id, line_no, uid, unit): the units of every line; each unit once a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[str]] = {}
        for batch in batches:
            ids, numbers, out = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, line in enumerate((text or "").split("\n")):
                    got = seen.get(line)
                    if got is None:
                        got = units(line, filler) if line.strip() else set()
                        if len(line) < 80 and len(seen) < 100_000:
                            seen[line] = got
                    for u in got:
                        ids.append(i), numbers.append(n), out.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(out, pa.string())], names=["page_id", "line_no", "unit"])

    return widened(pages.select(F.col("page_id").cast("bigint"), "text")).mapInArrow(run, "page_id bigint, line_no int, unit string").withColumn("uid", F.xxhash64("unit"))


def seeds(spark, filler: frozenset[str]) -> DataFrame:
    """(uid, unit, sim, talk) of the trusted lines."""
    rows = {}
    for text, talk in ((residue_seed.RESIDUE, False), (residue_seed.TALK, True)):
        for line in text.strip().split("\n"):
            rows[normal(line, filler)] = talk
    rows[TALKS] = True
    names = sorted(rows)
    sims = simhash(names).tolist()
    return spark.createDataFrame([(n, s, rows[n]) for n, s in zip(names, sims)], "unit string, sim bigint, talk boolean").select(F.xxhash64("unit").alias("uid"), "unit", "sim", "talk")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df



def _grams(text: str) -> frozenset[str]:
    """The set that similarity is measured on."""
    words = text.split(" ")
    if len(words) >= LONG:
        return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4))
    padded = f"^{text}$"
    return frozenset(padded[i : i + 4] for i in range(max(1, len(padded) - 3)))


def _near(nodes: DataFrame, frontier: DataFrame, radius: int = HAMMING, similar: bool = False) -> DataFrame:
    """(uid, unit, sim, f_unit, talk): nodes whose hash differs from one of the frontier in at most radius bits; with similar, only those
    whose shingle sets have a Jaccard of at least SIMILARITY.

    The frontier goes to every partition in pieces of BROADCAST_ROWS rows. With similar, a node meets only the rows whose sets have
    a size that allows SIMILARITY.
    """
    pieces, rows = [], []
    for r in frontier.select("unit", "sim", "talk").toLocalIterator():
        rows.append(r)
        if len(rows) == BROADCAST_ROWS:
            pieces.append(_near_piece(nodes, rows, radius, similar))
            rows = []
    if rows or not pieces:
        pieces.append(_near_piece(nodes, rows, radius, similar))
    return reduce(DataFrame.unionByName, pieces)


#: Added to the size of long units' sets, so that short and long ones, whose shingles differ in kind, never meet.
KIND = 1 << 40


def _sized(units: list[str]) -> tuple[list[frozenset[str]], np.ndarray]:
    """The shingle set of each unit, and its size, in order of kind."""
    sets = [_grams(u) for u in units]
    return sets, np.array([len(x) + KIND * (u.count(" ") >= LONG - 1) for x, u in zip(sets, units)], np.int64)


def _may_reach(unit: str, every: frozenset[str]) -> bool:
    """Whether the unit can have SIMILARITY with a set within every: of its shingles, at most the rest may be missing there."""
    words = unit.split(" ")
    n = len(words) - 4
    if len(words) >= LONG:
        shingles = (" ".join(words[i : i + 5]) for i in range(n))
    else:
        padded = f"^{unit}$"
        n = max(1, len(padded) - 3)
        shingles = (padded[i : i + 4] for i in range(n))
    allowed, missing = (1 - SIMILARITY) * n + 1e-9, set()
    for x in shingles:
        if x not in every:
            missing.add(x)
            if len(missing) > allowed:
                return False
    return True


def _near_piece(nodes: DataFrame, rows: list, radius: int, similar: bool) -> DataFrame:
    held, sizes = _sized([r.unit for r in rows]) if similar else ([frozenset()] * len(rows), np.zeros(len(rows), np.int64))
    order = np.argsort(sizes, kind="stable")
    rows, held, sizes = [rows[k] for k in order], [held[k] for k in order], sizes[order]
    names, talks = pa.array([r.unit for r in rows], pa.string()), pa.array([r.talk for r in rows], pa.bool_())
    every = frozenset().union(*held)
    known = np.array([r.sim for r in rows], np.int64) if all(r.sim is not None for r in rows) else simhash([r.unit for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            if similar:
                # Only units with enough shingles of the frontier as a whole are hashed: the others can't reach SIMILARITY with any of its rows.
                batch = batch.take(pa.array([k for k, u in enumerate(batch.column(1).to_pylist()) if _may_reach(u, every)], pa.int64()))
                texts = batch.column(1).to_pylist()
                own, mine = _sized(texts)
                # One shingle of slack, so that no rounding can drop a pair; the Jaccard decides.
                kind = mine // KIND * KIND
                lo = np.searchsorted(sizes, kind + np.floor(SIMILARITY * (mine - kind)).astype(np.int64) - 1, "left")
                hi = np.searchsorted(sizes, kind + np.ceil((mine - kind) / SIMILARITY).astype(np.int64) + 1, "right")
                sims = simhash(texts)
            else:
                sims = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                lo, hi = np.zeros(len(sims), np.int64), np.full(len(sims), len(known), np.int64)
            ends, took, met, start = np.cumsum(hi - lo), [], [], 0
            while start < len(sims):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
                n = (hi - lo)[start:stop]
                i = np.repeat(np.arange(start, stop), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)
                close = np.bitwise_count((sims[i] ^ known[j]).view(np.uint64)) <= radius
                for x, y in zip(i[close].tolist(), j[close].tolist()) if similar else ():
                    a, b = own[x], held[y]
                    shared = len(a & b)
                    if shared / (len(a) + len(b) - shared) >= SIMILARITY:
                        took.append(x), met.append(y)
                if not similar:
                    took += i[close].tolist()
                    met += j[close].tolist()
                start = stop
            take, j = batch.take(pa.array(took, pa.int64())), pa.array(met, pa.int64())
            yield pa.RecordBatch.from_arrays([*take.columns, names.take(j), talks.take(j)], names=["uid", "unit", "sim", "f_unit", "talk"])

    return nodes.select("uid", "unit", "sim").mapInArrow(run, "uid bigint, unit string, sim bigint, f_unit string, talk boolean")


def spread(nodes: DataFrame, trusted: DataFrame, radius: int = HAMMING) -> DataFrame:
    """(uid, talk): the labels of all nodes in a component with a trusted line. nodes: (uid, unit, sim); sim null: hashed where needed."""
    labelled = None
    frontier = trusted
    while True:
        found = _near(nodes, frontier, radius, similar=True).select("uid", "unit", "sim", "talk").distinct()
        if labelled is not None:
            found = found.join(labelled.select("uid", "talk"), ["uid", "talk"], "left_anti")
        frontier = checkpointed(found)
        if frontier.isEmpty():
            break
        new = frontier.select("uid", "talk")
        labelled = new if labelled is None else labelled.unionByName(new)
    if labelled is None:
        return frontier.select("uid", "talk")
    return labelled.groupBy("uid").agg(F.max("talk").alias("talk"))


def residue_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines that are residue."""
    filler = filler_words(pages)
    placed = written(page_units(pages, filler))
    nodes = written(placed.groupBy("uid").agg(F.first("unit").alias("unit"), F.lit(None).cast("bigint").alias("sim")))
    labels = checkpointed(spread(nodes, seeds(pages.sparkSession, filler), REACH))
    marked = placed.select("page_id", "line_no", "uid").join(_small(labels), "uid")
    return marked.groupBy("page_id", "line_no").agg(F.max("talk").alias("talk")).filter(~F.col("talk")).select("page_id", "line_no")


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id) of the pages whose text is or holds residue."""
    return residue_lines(pages).select("page_id").distinct()

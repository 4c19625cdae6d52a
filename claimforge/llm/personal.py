"""Problem 10: personal details in free text, by a linear-chain conditional random field.

Texts are cut into tokens (words, numbers, single signs; single characters where no spaces part words). A token's evidence is a sum
over the tokens within REACH of it: word, shape, ending, length, membership of fixed lists, and whether a run of signs
around it has the outline of an address of mail or of a telephone number. As every piece of evidence belongs to one token and one distance,
each distinct token's scores are looked up once and added up by numpy; Viterbi then decodes all lines of a batch
together, by position. The weights are trained on the driver from ``personal_seed`` (SENTENCES_PER_TEMPLATE bounds the table) by
gradient ascent on the conditional log-likelihood, with the forward-backward recursion, and are the same in every run.

What the field marks is then checked: mail needs a sign or word for "at", telephone and identity numbers enough digits, addresses a number.

Results at the edges: null texts have no details and stay null, '' and blank texts stay as they are; a value counts once per document;
repeated rows give repeated redactions, and one row each in ``find``; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import personal_seed
from claimforge.session import widened

SENTENCES_PER_TEMPLATE = 13
REACH = 3
KINDS = ("name", "email", "phone", "id_number", "address")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens decoded together; a single text may have more.
BATCH_TOKENS = 400_000
EPOCHS, BATCH, RATE, PRIOR = 12, 64, 0.12, 3e-6

_CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af々〆"
#: Words (cut where a capital follows a small letter, and after the check letter of a number), numbers (cut before a year with its sign), single signs.
TOKEN = re.compile(
    rf"[{_CJK}]|(?<=\d)[A-Z](?=[A-Z][a-z])|[^\W\d_{_CJK}A-Z]+(?:['’](?=[^\W\d_])[^\W\d_{_CJK}]+)*|[A-Z][^\W\d_{_CJK}A-Z]+(?:['’](?=[^\W\d_])[^\W\d_{_CJK}]+)*|[A-Z]+(?![^\W\d_{_CJK}A-Z])|[A-Z]"
    r"|\d+(?=(?:19|20)\d\d年)|\d+|[^\s]|\n"
)
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|punkt|punto)\s)"
MAIL = re.compile(rf"[a-z0-9][\w.+-]*(?:\s?@\s?|\s?[\[({{]\s?(?:@|at)\s?[\])}}]\s?|\s(?:at|@)\s)[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}(?-i:[a-z]{{2,10}}|[A-Z]{{2,10}}|[A-Z][a-z]{{1,9}})(?-i:(?![a-z0-9_-]))", re.I)
#: The outline of a telephone number: of 15 digits at most (as E.164 has it, see ``keys`` and ``checked``), so of 26 signs with what stands between.
DIGITS = re.compile(r"(?<![\w])(?:\+|\()?\d[\d\s()./-]{5,24}\d(?![\w])")
#: Outlines of public identity numbers: social security, national insurance, passports, identity cards, tax.
PAPERS = re.compile(
    r"(?<![\w-])(?:\d{3}[- ]\d\d[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z] ?\d{7,8}|[A-Z]{2}\d{7}|\d\d \d{3} \d{3} \d{3}|\d{11}|\d{13}|\d \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?)(?![\d-])"
)
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯々〆]")
ROAD = re.compile(r"(?:stra(?:ß|ss)e|str|weg|gasse|platz|allee|ufer|damm|ring|tor|berg)$")
# Words that stand beside personal details, by what they announce.
LISTS = {
    "road": "street st road rd lane avenue ave court blvd boulevard row drive close way square terrace place rue chemin allée quai cours impasse calle avenida plaza paseo camino carrer c",
    "address": "mr mrs ms miss mx dr prof professor frau herr m mme mlle madame monsieur sr sra srta señor señora don doña",
    "firm": "ltd inc gmbh ag kg ohg sarl sa sas llc plc llp sl kk group holding brothers sons fils hijos co corp limited",
    "phone": "tel t phone fax mobile hotline call ring telefon mobil handy rufen tél téléphone portable appelez teléfono móvil llame 電話 受付",
    "id": "ssn passport identity insurance national tax id licence license card steuer ausweisnummer personalausweises reisepass sozialversicherungsnummer sécurité sociale identité fiscal passeport dni nie pasaporte nif",
    "vat": "vat ust idnr hrb rcs cif tva siret registry invoice order part rechnung artikel commande pedido factura isbn",
    "unit": "percent euro euros eur sites hours weeks minutes days personnes personas leute stunden heures horas",
}
LIST_OF = {w: k for k, words in LISTS.items() for w in words.split()}


@lru_cache(1)
def _given() -> frozenset[str]:
    from claimforge.llm.variants import NICKNAMES

    names = {g.lower() for g in personal_seed.GIVEN}
    return frozenset(names | set(NICKNAMES) | {s for x in NICKNAMES.values() for s in x.split()})


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


#: Where an address of mail may have its "at", and the digits that every number holds: outlines are looked for around these only.
AT = re.compile(r"@|(?<=[\s\[({])at(?=[\s\])}])", re.I)
DIGIT_RUN = re.compile(r"\d+")
_LOCAL_BEGINS = "ſKıİ"


class Outlines:
    """What in a text has the outline of an address of mail, of a telephone number, of an identity number: the matches of MAIL, DIGITS and PAPERS."""

    __slots__ = ("mail", "digits", "papers")

    def __init__(self, text: str):
        self.mail, self.digits, self.papers = [], [], []
        end = 0
        for m in AT.finditer(text):
            if m.start() < end:
                continue
            k = m.start()
            k -= k > end and text[k - 1].isspace()
            if k > end and text[k - 1] in "[({":
                k -= 1
                k -= k > end and text[k - 1].isspace()
            # The local part is the longest run before; it begins with a plain letter or a digit.
            first = -1
            while k > end and (text[k - 1].isalnum() or text[k - 1] in "_.+-"):
                k -= 1
                if (text[k].isascii() and text[k].isalnum()) or text[k] in _LOCAL_BEGINS:
                    first = k
            if first >= 0 and (found := MAIL.match(text, first)):
                end = found.end()
                self.mail.append(found.span())
        end = after = 0
        for m in DIGIT_RUN.finditer(text):
            k = m.start()
            if k >= end and (found := (k > end and text[k - 1] in "+(" and DIGITS.match(text, k - 1)) or DIGITS.match(text, k)):
                end = found.end()
                self.digits.append(found.span())
            if k >= after:
                # Up to two capitals and a space or hyphen stand before the digits.
                for x in range(max(after, k - 3), k + 1):
                    if (x == k or "A" <= text[x] <= "Z") and (found := PAPERS.match(text, x)):
                        after = found.end()
                        self.papers.append(found.span())
                        break

    @staticmethod
    def around(outlines: list[tuple[int, int]], a: int, b: int) -> tuple[int, int] | None:
        """The outline that holds a to b."""
        k = bisect_right(outlines, a, key=lambda x: x[0]) - 1
        return outlines[k] if k >= 0 and b <= outlines[k][1] else None


def _count_digits(value: str) -> int:
    return sum(map(str.isdigit, value))


def keys(text: str, spans: list[tuple[int, int]], outlines: Outlines | None = None) -> list[tuple[str, int]]:
    """What a token is known by: its text and its flags (1: after a space, 2: in the outline of mail, 4: of digits like a telephone's, 8: of an identity number)."""
    outlines = outlines or Outlines(text)
    marked = bytearray(len(text) + 1)
    for a, b in outlines.mail:
        marked[a:b] = b"\x02" * (b - a)
    for a, b in outlines.digits:
        if 7 <= _count_digits(text[a:b]) <= 15:
            for i in range(a, b):
                marked[i] |= 4
    for a, b in outlines.papers:
        for i in range(a, b):
            marked[i] |= 8
    end, out = -1, []
    for a, b in spans:
        out.append((text[a:b], (a != end) | marked[a]))
        end = b
    return out


def shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 6)}"
    if WIDE.match(w):
        o = ord(w)
        return "kana" if 0x3040 <= o <= 0x30FF else "kanji"
    if not w[0].isalnum():
        return w
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    if w[0].isupper():
        return "Xx" if w[1:].islower() else "XxX"
    return "x" if len(w) == 1 else "xx"


@lru_cache(100_000)
def evidence(key: tuple[str, int]) -> tuple[str, ...]:
    """The features of a token, without distance."""
    w, flags = key
    low = w.lower()
    kind = shape(w)
    out = [f"w={low if not w.isdigit() else '0' * min(len(w), 6)}", f"s={kind}", f"s+={kind}{flags & 1}", f"f={flags}", f"sf={kind}{flags & 14}"]
    if w.isalpha():
        out += [f"e={low[-3:]}", f"e2={low[-2:]}", f"n={min(len(w), 8)}"]
        if low in _given():
            out.append(f"given{kind}")
        if (k := LIST_OF.get(low)) is not None:
            out += [f"l={k}", f"ls={k}{kind}"]
        if ROAD.search(low) and len(low) > 4:
            out.append("roadend")
    elif w.isdigit():
        out.append(f"year={len(w) == 4 and w[:2] in ('19', '20')}")
    return tuple(out)


class Field:
    """Weights of (feature, distance) by label, and of label pairs."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.moves, self.start = index, weights, moves, start
        self.known: dict[tuple[str, int], int] = {}
        self.rows: list[np.ndarray] = []

    def __getstate__(self):
        return (self.index, self.weights, self.moves, self.start)

    def __setstate__(self, state):
        self.__init__(*state)

    def _row(self, key: tuple[str, int]) -> int:
        """The number of the token's table of scores: one row for each distance from -REACH to REACH."""
        n = self.known.get(key)
        if n is None:
            found = [i for f in evidence(key) if (i := self.index.get(f)) is not None]
            table = self.weights[found].sum(axis=0) if found else np.zeros(self.weights.shape[1:], np.float32)
            if len(self.rows) > 300_000:
                self.known.clear()
                self.rows.clear()
            n = self.known[key] = len(self.rows)
            self.rows.append(table)
        return n

    def scores(self, batch: list[list[tuple[str, int]]]) -> np.ndarray:
        """The scores of all tokens of the texts, one text after the other."""
        if len(self.rows) > 250_000:
            self.known.clear()
            self.rows.clear()
        flat, lengths = [], []
        for text in batch:
            rows = list(map(self.known.get, text))
            if None in rows:
                rows = [self._row(k) if r is None else r for r, k in zip(rows, text)]
            flat += rows
            lengths.append(len(text))
        ids = np.array(flat, np.int64)
        used, ids = np.unique(ids, return_inverse=True)
        table = np.stack([self.rows[i] for i in used]) if len(used) else np.zeros((0, 2 * REACH + 1, len(LABELS)), np.float32)
        own = np.repeat(np.arange(len(lengths)), lengths)
        out = table[ids, REACH].copy() if len(ids) else np.zeros((0, len(LABELS)), np.float32)
        for d in range(1, REACH + 1):
            if len(ids) > d:
                same = (own[d:] == own[:-d])[:, None]
                out[d:] += np.where(same, table[ids[:-d], REACH - d], 0)
                out[:-d] += np.where(same, table[ids[d:], REACH + d], 0)
        return out

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of all segments, decoded together position by position; segments are sorted by length."""
        labels = np.zeros(len(scores), np.int8)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        if not len(lengths):
            return labels
        longest = int(lengths[0])
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # segments longer than t
        best = self.start + scores[starts]
        back = []
        final = np.zeros(len(starts), np.int64)
        for t in range(1, longest):
            n = alive[t]
            done = slice(n, len(best))
            final[n : len(best)] = best[done].argmax(axis=1)
            step = best[:n, :, None] + self.moves[None]
            back.append(step.argmax(axis=1).astype(np.int8))
            best = step.max(axis=1) + scores[starts[:n] + t]
        final[: len(best)] = best.argmax(axis=1)
        now = final
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            labels[starts[:n] + t] = now[:n]
            if t:
                now[:n] = back[t - 1][np.arange(n), now[:n]]
        return labels

    def mark(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the personal details of each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        prepared: dict[int, tuple[list[tuple[int, int]], list[tuple[str, int]], Outlines]] = {}

        def decode():
            scores = self.scores([prepared[i][1] for i in group])
            starts, lengths, base = [], [], 0
            for i in group:
                ks = prepared[i][1]
                for a, b in segments(ks):
                    starts.append(base + a)
                    lengths.append(b - a)
                base += len(ks)
            labels = self.viterbi(scores, np.array(starts, np.int64), np.array(lengths, np.int64))
            base = 0
            for i in group:
                spans, ks, outlines = prepared.pop(i)
                out[i] = checked(texts[i], spans, labels[base : base + len(ks)], outlines)
                base += len(ks)

        for i, text in enumerate(texts):
            spans = tokens(text)
            if not spans:
                continue
            outlines = Outlines(text)
            prepared[i] = (spans, keys(text, spans, outlines), outlines)
            group.append(i)
            size += len(spans)
            if size > BATCH_TOKENS:
                decode()
                group, size = [], 0
        if group:
            decode()
        return out


def segments(ks: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """The runs of tokens that are decoded on their own: the lines, of any length."""
    ends = [-1, *(i for i, k in enumerate(ks) if k[0] == "\n"), len(ks)]
    return [(a + 1, b) for a, b in zip(ends, ends[1:]) if b > a + 1]


ABBREVIATED = re.compile(r"(?:\b(?:St|Rd)|str|Str)\.$")
KANJI_NAME = re.compile(r"[一-鿿々]{1,4}(?:[ 　]?[一-鿿々ぁ-んァ-ヴー]{1,4})?")
SENTENCE_END = re.compile(r"\w{2,}(\.)\s")
#: District and block number of a Japanese address.
BLOCK = re.compile(r"\d+\s?[-－‐−]\s?\d+|丁目|番地?|号")


def checked(text: str, spans: list[tuple[int, int]], labels: np.ndarray, outlines: Outlines) -> list[tuple[int, int, str]]:
    """The marked spans that pass the plain checks of their kind."""
    out = []
    hits = np.flatnonzero(labels)
    i = 0
    while i < len(hits):
        first = hits[i]
        kind = (labels[first] - 1) // 2
        last = first
        while i + 1 < len(hits) and hits[i + 1] == last + 1 and labels[hits[i + 1]] == 2 + 2 * kind:
            i += 1
            last = hits[i]
        i += 1
        a, b = spans[first][0], spans[last][1]
        name = KINDS[kind]
        while b > a and text[b - 1] in ",;:|<>\"“”" or (name in ("email", "phone", "id_number") and b > a and text[b - 1] in ".-/("):
            b -= 1
        while a < b and text[a] in ",;:|<>\"“”. -–—":
            a += 1
        if name == "name":
            # A sentence ends inside: the name is what stands before it.
            if m := SENTENCE_END.search(text, a, b):
                b = m.start(1)
            while b > a and text[b - 1] == "." and not re.search(r"(?:^|[\s.])\w\.$", text[a:b]):
                b -= 1
            if WIDE.search(text, a, b) and (m := KANJI_NAME.search(text, a, b)):
                a, b = m.span()
        elif name in ("phone", "id_number"):
            while a < b and not (text[a].isdigit() or text[a] in "+(" or (name == "id_number" and text[a].isascii() and text[a].isupper())):
                a += 1
            # A number is taken as a whole: its outline, if that holds what was marked.
            whole = Outlines.around(outlines.papers if name == "id_number" else outlines.digits, a, b)
            if whole and _count_digits(text[whole[0] : whole[1]]) <= 15:
                a, b = whole
            else:
                if name == "id_number" and (m := re.match(r"(?:[A-Z]{1,2}[ -]?)?\d[\d ./-]*\d(?:-?[A-Z](?![\w'’]))?", text[a:b])):
                    b = a + m.end()
        elif name == "address":
            if WIDE.search(text, a, b):
                a = max(a, text.rfind(" ", a, b) + 1)
            elif m := re.match(r"(?:[^\W\d_A-Z]+ )+(?=\d)", text[a:b]):
                a += m.end()  # a preposition before the number
            if text[b : b + 1] == "." and ABBREVIATED.search(text[a : b + 1]):
                b += 1
            elif text[b - 1 : b] == "." and not ABBREVIATED.search(text[a:b]):
                b -= 1
        elif name == "email":
            # Whole addresses: every outline of one that the marked span touches.
            k = max(0, bisect_right(outlines.mail, a, key=lambda x: x[0]) - 1)
            while k < len(outlines.mail) and outlines.mail[k][0] < b:
                x, y = outlines.mail[k]
                if y > a and not (out and out[-1][2] == "email" and out[-1][1] > x):
                    out.append((x, y, name))
                k += 1
            continue
        value = text[a:b]
        digits = sum(c.isdigit() for c in value)
        fine = {
            "name": bool(value) and any(c.isalpha() for c in value) and digits == 0 and "=" not in value,
            "phone": 7 <= digits <= 16,
            "id_number": digits >= 5,
            "address": digits >= 1 and bool(BLOCK.search(value) if WIDE.search(value) else any(ROAD.search(w) or LIST_OF.get(w) == "road" for w in re.findall(r"[^\W\d_]+", value.lower())) or re.match(r"(?:Am|An|Auf|Im|In|Zum|Zur|Unter)\b", value)),
        }[name]
        if not fine:
            continue
        if name == "name" and out and out[-1][2] == "name" and text[out[-1][1] : a] == "-":
            a = out.pop()[0]  # the second half of a double name
        out.append((a, b, name))
    return out


# ---- training ---------------------------------------------------------------------------------------


def _labelled(text: str, marks: list[tuple[int, int, str]]) -> tuple[list[tuple[str, int]], list[int]]:
    spans = tokens(text)
    labels = [0] * len(spans)
    for a, b, kind in marks:
        inside = [i for i, (x, y) in enumerate(spans) if x < b and y > a]
        for n, i in enumerate(inside):
            labels[i] = 1 + 2 * KINDS.index(kind) + (n > 0)
    return keys(text, spans), labels


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> Field:
    """The field fitted to labelled texts by minibatch gradient ascent (Adam) on the conditional log-likelihood."""
    width, span = len(LABELS), 2 * REACH + 1
    lines = []
    for text, marks in table:
        ks, labels = _labelled(text, marks)
        # As in decoding, lines are chains of their own, but evidence reaches over their ends.
        lines.append((ks, labels, segments(ks)))
    seen: dict[str, int] = {}
    for ks, _, _ in lines:
        for k in ks:
            for f in evidence(k):
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
    weights = np.zeros((len(index) * span, width), np.float64)
    moves, start = np.zeros((width, width)), np.zeros(width)
    for j in range(1, width):
        if j % 2 == 0:  # an I only follows the B or I of its kind
            start[j] = -1e4
            moves[[i for i in range(width) if i not in (j - 1, j)], j] = -1e4
    free_moves, free_start = moves == 0, start == 0
    state = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in (("w", weights), ("m", moves), ("s", start))}
    prepared = []
    for ks, labels, segs in lines:
        own = [np.array([index[f] for f in evidence(k) if f in index], np.int64) for k in ks]
        for a, b in segs:
            rows, sizes = [], []
            for t in range(a, b):
                # Evidence of the token at distance d counts in slot REACH + d.
                mine = [own[t + d] * span + REACH + d for d in range(-REACH, REACH + 1) if 0 <= t + d < len(ks)]
                rows += mine
                sizes.append(sum(map(len, mine)))
            prepared.append((np.concatenate(rows), np.array(sizes), np.array(labels[a:b])))
    rng = np.random.default_rng(3)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(prepared))
        for at in range(0, len(order), BATCH):
            part = sorted((prepared[i] for i in order[at : at + BATCH]), key=lambda p: -len(p[2]))
            n, longest = len(part), len(part[0][2])
            features = np.concatenate([p[0] for p in part])
            sizes = np.concatenate([p[1] for p in part])
            lengths = np.array([len(p[2]) for p in part])
            # The place of each token, text after text, in the table of positions by texts.
            place = np.concatenate([np.arange(m) * n + k for k, m in enumerate(lengths)])
            emit = np.zeros((longest * n, width))
            emit[place] = np.add.reduceat(weights[features], np.cumsum(sizes) - sizes)
            emit = emit.reshape(longest, n, width)
            live = np.arange(longest)[:, None] < lengths
            # Forward and backward in chances, scaled to sum to 1 at every place; an impossible move has chance 0.
            local, step_to = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves)
            alpha, beta, scale = np.zeros((longest, n, width)), np.ones((longest, n, width)), np.ones((longest, n, 1))
            alpha[0] = np.exp(start) * local[0]
            scale[0] = alpha[0].sum(axis=1, keepdims=True)
            alpha[0] /= scale[0]
            # Texts are sorted by length: the first alive[t] of them have a place t.
            alive = live.sum(axis=1)
            for t in range(1, longest):
                m = alive[t]
                new = (alpha[t - 1, :m] @ step_to) * local[t, :m]
                scale[t, :m] = new.sum(axis=1, keepdims=True)
                alpha[t, :m] = new / scale[t, :m]
            after = np.zeros((longest, n, width))
            for t in range(longest - 1, 0, -1):
                m = alive[t]
                after[t, :m] = local[t, :m] * beta[t, :m] / scale[t, :m]
                beta[t - 1, :m] = after[t, :m] @ step_to.T
            chance = alpha * beta * live[:, :, None]
            gold = np.zeros_like(chance)
            pair = np.zeros((width, width))
            first = np.zeros(width)
            for k, (_, _, y) in enumerate(part):
                gold[np.arange(len(y)), k, y] = 1
                np.add.at(pair, (y[:-1], y[1:]), 1)
                first[y[0]] += 1
            pair -= step_to * np.tensordot(alpha[:-1], after[1:], axes=([0, 1], [0, 1]))
            first -= chance[0].sum(axis=0)
            off = (gold - chance).reshape(longest * n, width) / n
            order_of = np.argsort(features, kind="stable")
            ordered = features[order_of]
            begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            touched = ordered[begins]
            slope = np.add.reduceat(off[np.repeat(place, sizes)[order_of]], begins)
            slope -= PRIOR * weights[touched]
            step += 1
            rate = RATE * (1 - 0.9 * (epoch / epochs))
            for name, value, grad, where in (("w", weights, slope, touched), ("m", moves, pair / n * free_moves, slice(None)), ("s", start, first / n * free_start, slice(None))):
                m1, m2 = state[name]
                m1[where] = 0.9 * m1[where] + 0.1 * grad
                m2[where] = 0.999 * m2[where] + 0.001 * grad**2
                value[where] += rate * (m1[where] / (1 - 0.9**step)) / (np.sqrt(m2[where] / (1 - 0.999**step)) + 1e-6)
    return Field(index, weights.reshape(len(index), span, width).astype(np.float32), moves.astype(np.float32), start.astype(np.float32))


@lru_cache(1)
def field(per_template: int = SENTENCES_PER_TEMPLATE) -> Field:
    return train(personal_seed.sentences(per_template))


# ---- operators --------------------------------------------------------------------------------------

#: Documents decoded together; a batch of fewer tokens than BATCH_TOKENS each time.
CHUNK = 1024


def _marked(texts: list[str | None], model: Field) -> Iterator[tuple[int, str | None, list[tuple[int, int, str]]]]:
    for at in range(0, len(texts), CHUNK):
        part = texts[at : at + CHUNK]
        for k, marks in enumerate(model.mark([t or "" for t in part])):
            yield at + k, part[k], marks


def find(df: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, value): every personal detail as written, once per document."""
    source = widened(df.select(key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, values = [], [], []
            for i, t, marks in _marked(batch.column(1).to_pylist(), model):
                for k, v in dict.fromkeys((k, t[a:b]) for a, b, k in marks):
                    rows.append(i), kinds.append(k), values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["key", "kind", "value"])

    return source.mapInArrow(run, f"key {kind}, kind string, value string").withColumnRenamed("key", key)


def redact(df: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the texts with [NAME], [EMAIL], [PHONE], [ID_NUMBER] and [ADDRESS] in place of the details."""
    source = widened(df.select(key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, t, marks in _marked(batch.column(1).to_pylist(), model):
                if t is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for a, b, k in marks:
                    parts += [t[at:a], f"[{k.upper()}]"]
                    at = b
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return source.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

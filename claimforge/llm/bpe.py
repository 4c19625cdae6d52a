"""Problem 8: byte-level BPE by backtracking over Aho-Corasick matches.

A byte string has exactly one tokenisation in which every neighbouring pair of tokens is *compatible*,
that is, in which encoding the two tokens' joined bytes gives these two tokens again; and that
tokenisation is what merging by rank gives. So the encoder walks from left to right, takes the longest
token that matches, and accepts it only if it is compatible with the token before; otherwise it tries the
next shorter one, and when none is left it gives up its last token and marks that position as a dead end.
Every position is given up at most once, which keeps the walk linear in the length of the text.

Null, empty and blank texts: a null text and an empty text both have the empty list of ids; blank text is
encoded like any other. Ids never include special tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimforge.session import widened

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Distinct pieces whose ids a Python worker remembers; a full memory is emptied, the result stays the same.
MEMORY = 200_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Exact encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        special = set()
        spelled = {}
        for text, i in model["vocab"].items():
            if all(c in letters for c in text):
                spelled[i] = bytes(letters[c] for c in text)
            else:
                special.add(i)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in merges}
        # A token that no merge makes and that is longer than a byte (<|endoftext|>) can't come from text.
        single = {i: b for i, b in spelled.items() if len(b) == 1}
        self.vocab = model["vocab"]
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {i: -1 for i in single}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank_of_pair[left, right] = rank
            if whole not in self.halves:
                self.halves[whole] = (left, right)
                self.rank[whole] = rank
        self.spelled = {i: b for i, b in spelled.items() if i in self.rank}
        self.size = {i: len(b) for i, b in self.spelled.items()}
        by_bytes = {b: i for i, b in self.spelled.items()}
        self.by_bytes = {b.decode("latin-1"): i for b, i in by_bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.by_bytes.items():
            self.automaton.add_word(b, i)
        self.automaton.make_automaton()
        self.shorter = {i: self._shorter(b) for b, i in self.by_bytes.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        last = max(self.spelled) + 1
        lengths = np.zeros(last, np.int64)
        for i, n in self.size.items():
            lengths[i] = n
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.blob = np.frombuffer(b"".join(self.spelled.get(i, b"") for i in range(last)), np.uint8)

    def _shorter(self, b: str) -> int:
        """The longest token that is a proper prefix of b, or -1."""
        for n in range(len(b) - 1, 0, -1):
            if (i := self.by_bytes.get(b[:n])) is not None:
                return i
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens stay as they are when their bytes stand next to each other.

        Takes the later merge of the two apart again and again; the pair is broken if, before that merge
        was made, a merge across the border would have come first.
        """
        found = self.pairs.get((left, right))
        if found is not None:
            return found
        a, b = left, right
        before_left = before_right = 1 << 60  # ranks below which a merge across the border comes first
        ok = True
        while True:
            across = self.rank_of_pair.get((a, b))
            if across is not None and across < before_left and across <= before_right:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # Undo the later of the two merges. At equal ranks the left one is made first, so the right is undone first.
            if ra > rb:
                # Its right half stays at the border: a merge across it wins over this one only with a lower rank.
                before_left, before_right = ra, min(before_right, ra)
                a = self.halves[a][1]
            else:
                # Its left half stays; at the same rank the merge further left, that is the one across, comes first.
                before_right, before_left = rb, min(before_left, rb + 1)
                b = self.halves[b][0]
        if len(self.pairs) > 4 * MEMORY:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def encode_piece(self, data: str) -> tuple[int, ...]:
        """data: the bytes of one piece, as Latin-1 text."""
        whole = self.by_bytes.get(data)
        if whole is not None and len(data) == 1:
            return (whole,)
        n = len(data)
        longest = [-1] * n
        size = self.size
        for end, i in self.automaton.iter(data):
            start = end - size[i] + 1
            if longest[start] < 0 or size[longest[start]] < size[i]:
                longest[start] = i
        alive = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        compatible, shorter = self.compatible, self.shorter
        while at < n:
            while token >= 0:
                end = at + size[token]
                if alive[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                back = out.pop()
                at -= size[back]
                token = shorter[back]
        return tuple(out)

    def piece(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text)
        if found is None:
            found = self.encode_piece(text.encode("utf-8", "surrogatepass").decode("latin-1"))
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.split(text or ""):
            out += known.get(p) or self.piece(p)
        return out

    def count(self, text: str | None) -> int:
        known = self.known
        return sum([len(known.get(p) or self.piece(p)) for p in self.split(text or "")])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered by the table of offsets."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts, lengths = self.starts[ids], self.ends[ids] - self.starts[ids]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
        return self.blob[place].tobytes()


@lru_cache(4)
def encoder(name: str = DEFAULT_TOKENIZER, path: str | None = None) -> Encoder:
    import public_tokenizers

    return Encoder(path or vocabulary_path(name), public_tokenizers.PATTERN)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT_TOKENIZER, path: str | None = None) -> DataFrame:
    """(key, ids): the ids of every row, one row per row of df; null and empty texts have no ids ([])."""
    source = widened(df.select(key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, path).encode
        for batch in batches:
            flat, ends = [], [0]
            for value in batch.column(1).to_pylist():
                flat += encode(value)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, text: str = "text", name: str = DEFAULT_TOKENIZER, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """df's columns except the text, and the number of the text's tokens (0 for null and empty texts)."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema) + f", `{out}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(name, path).count
        for batch in batches:
            sizes = pa.array([count(x) for x in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], sizes], names=[*kept, out])

    return widened(df.select(*kept, text)).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = DEFAULT_TOKENIZER, path: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids; a null list has a null text, an empty list an empty one."""
    source = df.select(key, ids)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(name, path).decode
        for batch in batches:
            texts = [None if x is None else decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return source.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

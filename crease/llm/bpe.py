"""Operator 10: byte-level BPE by monoid tree reduction.

A text is cut in halves down to leaves of ``LEAF`` characters, each leaf is
encoded, and neighbours are joined up the tree.  A join re-encodes a window
around the seam and keeps all tokens outside it:

* A place between a visible character and white space is a boundary of the
  split pattern in every context, because no alternative of the pattern spans
  it.  The window grows, on either side, to the nearest such place; tokens
  beyond it cannot change.
* Inside one long match (a run without white space) halves are joined on
  tokens.  An id sequence is the BPE encoding of its bytes exactly when every
  adjacent pair of ids is the encoding of that pair's bytes, so the window
  doubles until the pairs at both of its ends hold.

Decoding maps ids to bytes in leaves and concatenates the leaves up the tree.

Spark deals whole documents to tasks; a task works batch by batch and holds one
document's text and ids at a time besides the batch.

Defined cases.  Null text counts as empty and has no ids; white space only,
text without white space and repeated rows need nothing special; an empty table
gives no rows.  Only the named columns are read and returned.  Decoding null
ids gives no bytes; an id without a token raises.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crease.llm.common import only

LEAF = 4096  # characters of a leaf
RUN_LEAF = 2048  # bytes of a leaf inside one match
CACHED_WORDS = 300_000  # entries, then the cache starts anew
CACHED_CHARS = 40  # longer words are not kept
ROWS_OUT = 256  # documents in an output batch

# The characters with the Unicode property White_Space
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_PAIR = re.compile(f"[{SPACES}][{SPACES}]")
SPACE = re.compile(f"[{SPACES}]")
SEAM = re.compile(f"[^{SPACES}][{SPACES}]")


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes; words seen before come from a bounded cache.

    Where no two white-space characters meet, the text is cut before every
    blank: that is a place between a visible character and white space, hence
    a boundary of the split pattern.  New words are encoded together, with line
    feeds between them, whose id tells them apart.  Other texts are encoded in
    one go.
    """

    def __init__(self, base):
        self.base = base
        (self.line_feed,) = base.encode_ordinary("\n")
        self.after_blank: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return array("I", self.base.encode_ordinary(text)).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w and not SPACE.search(w)]
        new = {w: self.direct(" " + w) for w in set(words).difference(plain)}
        ids = np.array(self.base.encode_ordinary("".join(f" {w}\n" for w in plain)), dtype="<u4")
        data, start = ids.tobytes(), 0
        for w, end in zip(plain, (np.flatnonzero(ids == self.line_feed) * 4).tolist(), strict=True):
            new[w] = data[start:end]
            start = end + 4
        return new

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACE_PAIR.search(text):
            return self.direct(text)
        first, *words = text.split(" ")
        found = list(map(self.after_blank.get, words))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            new = self._learn(list({words[i] for i in at}))
            for i in at:
                found[i] = new[words[i]]
            if len(self.after_blank) > CACHED_WORDS:
                self.after_blank.clear()
            self.after_blank.update((w, ids) for w, ids in new.items() if len(w) <= CACHED_CHARS)
        if first:
            found.insert(0, self.direct(first))
        return b"".join(found)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Tree-reduced encoder and decoder over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, run_leaf: int = RUN_LEAF):
        import regex
        import tiktoken

        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.run_bytes = leaf, run_leaf
        self.words = WordIds(self.base)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_bytes = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- texts

    def encode(self, text: str) -> np.ndarray:
        return self._node(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        return np.frombuffer(self.words(text), dtype="<u4")

    def _node(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        start, end = self._last_seam(text, lo, mid), self._first_seam(text, mid, hi)
        window = text[start:end]
        inner = self._leaf(window) if len(window) <= self.leaf_chars else self._long_window(window)
        before = left[:0] if start == lo else left[: len(left) - self._tail(left, len(text[start:mid].encode()))]
        after = right[:0] if end == hi else right[self._head(right, len(text[mid:end].encode())) :]
        return np.concatenate([before, inner, after])

    @staticmethod
    def _last_seam(text: str, lo: int, mid: int) -> int:
        """Start of the window: the last stable boundary left of the seam, or the node's start."""
        size = 64
        while True:
            at = max(lo, mid - size)
            found = [m.start() + 1 for m in SEAM.finditer(text, at, mid)]
            if found:
                return found[-1]
            if at == lo:
                return lo
            size *= 2

    @staticmethod
    def _first_seam(text: str, mid: int, hi: int) -> int:
        found = SEAM.search(text, mid, hi)
        return found.start() + 1 if found else hi

    def _head(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading ids cover ``n_bytes`` bytes."""
        size = 16
        while True:
            ends = np.cumsum(self.token_bytes[ids[:size]])
            if len(ends) == len(ids) or ends[-1] >= n_bytes:
                return int(np.searchsorted(ends, n_bytes)) + 1 if n_bytes else 0
            size *= 2

    def _tail(self, ids: np.ndarray, n_bytes: int) -> int:
        return self._head(ids[::-1], n_bytes)

    def _long_window(self, window: str) -> np.ndarray:
        """A window beyond a leaf: one match after another, long matches by their own tree."""
        parts = []
        for m in self.pattern.finditer(window):
            piece = m.group().encode()
            parts.append(np.asarray(self._run(piece), dtype="<u4"))
        return np.concatenate(parts) if parts else np.empty(0, dtype="<u4")

    # -- one match of the pattern

    def _bpe(self, data: bytes) -> list[int]:
        return self.base._encode_single_piece(data)

    def _run(self, data: bytes) -> list[int]:
        if len(data) <= self.run_bytes:
            return self._bpe(data)
        mid = len(data) // 2
        return self._join_run(self._run(data[:mid]), self._run(data[mid:]))

    def _holds(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > CACHED_WORDS:
                self.pairs.clear()
            self.pairs[a, b] = self._bpe(self.tokens[a] + self.tokens[b]) == [a, b]
        return self.pairs[a, b]

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        if self._holds(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self._bpe(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._holds(left[i - 1], window[0])) and (j == len(right) or self._holds(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    # -- ids

    def decode(self, ids: np.ndarray) -> bytes:
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + LEAF].tolist())) for i in range(0, len(ids), LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker, so that tasks share its cached words."""
    return Codec(read_ranks(ranks_path), pattern)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_OUT):
            yield batch.slice(at, ROWS_OUT)


def encode(df: DataFrame, text: str, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """Columns ``keep`` of every row and ``ids`` (array<int>) of its whole text."""
    kept = [f"_k{i}" for i in range(len(keep))]
    source = only(df, *keep, text).toDF(*kept, "_text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in _slices(batches):
            found = [bpe.encode(t or "") for t in batch.column("_text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([*found, np.empty(0, dtype="<u4")]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, "ids")


def decode(df: DataFrame, ids: str, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """Columns ``keep`` of every row and ``decoded`` (binary): the bytes that the ids stand for."""
    kept = [f"_k{i}" for i in range(len(keep))]
    source = only(df, *keep, ids).toDF(*kept, "_ids")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in _slices(batches):
            lists = batch.column("_ids")
            decoded = [bpe.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, "decoded")

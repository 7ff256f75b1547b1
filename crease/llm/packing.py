"""Operator 4: best-fit packing with certified bounds.

1. Whole texts become token ids, the strings of added tokens their own; only documents longer than a sequence are cut,
   and the first piece takes the remainder.  A piece is one small row.
2. Pieces are dealt round robin to partitions of about ``ITEMS`` rows, each
   packed by best-fit decreasing.
3. Dual-feasible functions give every partition, and all rows together, a lower
   bound on the number of sequences.  When the total meets its bound, it is
   certified and nothing is left to do.  Otherwise partitions send their loosest
   sequences to an exchange: eight for each sequence above the partition's own
   bound, and as many again for its share of the total's gap.
4. What was exchanged is dealt to fewer partitions and packed anew, until the
   total is certified or one partition is left.  Rows of a round are written
   before the next, so nothing settled is computed twice.

Partitions hold a bounded number of rows; the driver sees only row counts, in
all and by length.

Defined cases.  Null text counts as empty: one piece with the end token.  Null
and repeated document ids and repeated rows are packed like any others, as
identity plays no part.  An empty table gives no rows.  Only the named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.bpe import WordIds
from crease.llm.common import only, stored

ITEMS = 200_000  # rows packed by one task
SHRINK = 8  # partitions of a round to one of the next
FULL = np.iinfo(np.int64).max  # rank of a full bin
PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


# -- tokens


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 as itself, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_ids(tokenizer_json: str, pattern: str) -> WordIds:
    """The vocabulary of a byte-level BPE tokenizer file; ids rise with the merges, so they serve as ranks."""
    import tiktoken

    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    to_byte = printable_bytes()
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return WordIds(tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))


@lru_cache(maxsize=2)
def text_ids(tokenizer_json: str, pattern: str):
    """Encoder of texts as the tokenizer file has it: its added tokens' strings become their single ids, the rest words."""
    with open(tokenizer_json, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    words = word_ids(tokenizer_json, pattern)
    ids = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
    longest_first = sorted(ids, key=lambda c: (-len(c), c))
    edges = re.compile("|".join(map(re.escape, longest_first))) if ids else None

    def encode(text: str) -> bytes:
        found, at = [], 0
        for m in edges.finditer(text) if edges else ():
            found += [words(text[at : m.start()]), ids[m.group()]]
            at = m.end()
        return b"".join([*found, words(text[at:])]) if found else words(text)

    return encode


def cut(n_tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, after a first piece with the remainder."""
    first = n_tokens if n_tokens <= size else n_tokens % size or size
    return [(0, first), *((at, size) for at in range(first, n_tokens, size))]


def pieces(df: DataFrame, doc_id: str, text: str, tokenizer_json: str, pattern: str, end_id: int, size: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    source = only(df, doc_id, text).toDF("_id", "_text")
    schema = T.StructType([source.schema.fields[0], *PIECE_FIELDS])

    def run(batches):
        encode = text_ids(tokenizer_json, pattern)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, made = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                ids = encode(t or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    row.append(i)
                    made.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = np.array(made, dtype=np.int64).reshape(-1, 4).T
            ids = batch.column("_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=schema.names
            )

    return source.mapInArrow(run, schema).withColumnRenamed("_id", doc_id)


# -- bounds and packing of one partition


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Largest bound on the number of bins over two families of dual-feasible functions, in whole numbers.

    ``count[s]`` is the number of items of length s."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    for k in range(1, capacity // 2 + 1):  # drop items below k, round items above capacity - k up to a bin
        value = np.where(size > capacity - k, capacity, np.where(size >= k, size, 0))
        best = max(best, -(-int(count @ value) // capacity))
    for k in range(1, 65):  # round (k + 1) x down to whole numbers, in k-ths of a bin
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; among open bins the one with the least room that suffices."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    n_bins = n_full = int(np.count_nonzero(lengths == capacity))
    bins[order[:n_full]] = np.arange(n_full)
    open_bins: dict[int, list[int]] = defaultdict(list)  # by room
    rooms = 0  # bit r: a bin with room r is open
    for i, size in zip(order[n_full:].tolist(), lengths[order[n_full:]].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return bins, offsets


def looseness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Rank of each bin from the loosest, less eight for each bin above the partition's bound; full bins come last."""
    fill = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.empty(0, dtype=np.int64)
    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    rank = np.empty(len(fill), dtype=np.int64)
    rank[np.argsort(fill, kind="stable")] = np.arange(len(fill)) - 8 * gap
    rank[fill == capacity] = FULL
    return rank


# -- on Spark


def _pack_round(items: DataFrame, partitions: int, number: int, capacity: int) -> DataFrame:
    names = items.columns
    schema = T.StructType(
        [
            *items.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("_rank", T.LongType()),
        ]
    )

    def run(batches):
        rows = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        lengths = rows.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        rank = looseness(lengths, bins, capacity)[bins]
        ids = (np.int64(number) << 58) | (np.int64(TaskContext.get().partitionId()) << 32) | bins
        columns = [*rows.columns, pa.chunked_array([ids]), pa.chunked_array([offsets]), pa.chunked_array([rank])]
        yield from pa.Table.from_arrays(columns, names=schema.names).to_batches(max_chunksize=20_000)

    return items.select(*names).repartition(partitions).mapInArrow(run, schema)


def length_counts(rows: DataFrame, capacity: int) -> np.ndarray:
    """How many rows have each length; at most ``capacity`` numbers."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["length"]] = r["n"]
    return count


def pack(items: DataFrame, capacity: int, items_per_task: int = ITEMS) -> DataFrame:
    """Rows of ``items`` (with a ``length`` from 1 to ``capacity``) and their ``sequence_id`` and ``offset``."""
    names = items.columns
    pool, settled, n_settled, number = stored(items, "pack-items"), [], 0, 0
    bound = lower_bound(length_counts(pool, capacity), capacity)
    partitions = max(1, -(-pool.count() // items_per_task))
    while True:
        packed = stored(_pack_round(pool, partitions, number, capacity), "pack-round")
        gap = n_settled + packed.where("offset = 0").count() - bound
        if partitions == 1 or gap <= 0:
            settled.append(packed)
            break
        send = F.col("_rank") < 1 + 8 * -(-gap // partitions)
        settled.append(packed.where(~send))
        n_settled += settled[-1].where("offset = 0").count()
        pool, number = packed.where(send).select(*names), number + 1
        wanted = max(-(-partitions // SHRINK), -(-pool.count() // items_per_task))
        partitions = max(1, min(partitions - 1, wanted))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.drop("_rank")


def certificate(packed: DataFrame, capacity: int) -> dict[str, int]:
    """Sequences used and the least number that any packing needs."""
    bound = lower_bound(length_counts(packed, capacity), capacity)
    return {"sequences": packed.where("offset = 0").count(), "bound": bound}

"""Operator 9: substring dedup by content-defined chunks.

A gear hash of the last 8 bytes rolls over the text; a chunk ends where the hash
is the least of its neighbourhood, ``mean // 2`` bytes to each side.  So borders
depend only on nearby text, wherever a passage stands, and after an insertion
they fall into step again within a chunk or two.  Chunks are at least half the
mean long and seldom beyond twice the mean, unlike those of a hash below a fixed
threshold, whose long tail hides whole passages of 50 words.  Chunks are known
by a 96-bit digest.  Of a chunk in several documents, the document with the
smallest id keeps it; others lose it, as they lose repeats inside themselves,
where the repeated chunks in a row make up at least ``min_run`` bytes.  Shorter
repeats are ordinary phrases and stay.

Spark counts digests with a combine before the shuffle, so a chunk that a third
of all documents share is one row per task there.  Its occurrences meet the
digest's one row in a join that Spark may split where it is skewed, and what a
document loses, at most its own chunks, joins its text once.

Defined cases.  Null text stays null and an empty text empty, with no chunks.
Rows equal in id count as one document: what they share stays in both.  A null
id stands after all others, and documents without id don't take from one
another.  Texts without any border are one chunk; a constant run, or one that
loops within half the mean, has no border.
Borders move to the next whole character.  Empty table: no rows.  Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only

MEAN_CHUNK = 32  # bytes, about
MIN_RUN = 112  # bytes of repeated chunks in a row
WINDOW = 8  # bytes that the rolling hash sees
BLOCK = 1 << 22  # bytes hashed at a time
ROWS_OUT = 100_000

GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=2).digest() for b in range(256)), dtype="<u2")


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _block_borders(data: np.ndarray, half: int) -> np.ndarray:
    """Bytes after which a chunk may end: the rolling hash is below the ``half`` before and not above the ``half`` after."""
    if len(data) < WINDOW + 2 * half:
        return np.empty(0, dtype=np.int64)
    h = GEAR[data]
    for step in (1, 2, 4):  # sums over 2, 4 and 8 bytes, two bits a byte
        older = h[:-step] << np.uint16(2 * step)
        h = h.copy()
        h[step:] += older
    h = h[WINDOW - 1 :]
    least = _least_of(h, half)
    mid = h[half : len(h) - half]
    return np.flatnonzero((mid < least[: len(mid)]) & (mid <= least[half + 1 : half + 1 + len(mid)])) + (WINDOW - 1 + half)


def borders(text: bytes, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Chunk borders of a text, 0 and its length included."""
    data = np.frombuffer(text, dtype=np.uint8)
    half, found = mean // 2, []
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW - 1 + half)
        ends = _block_borders(data[at - lead : at + BLOCK + half], half)
        found.append(ends + (at - lead + 1))
    at = np.concatenate([np.zeros(1, dtype=np.int64), *found, np.full(1, len(data))])
    for _ in range(3):  # to the start of a character
        inside = at < len(data)
        inside[inside] = (data[at[inside]] & 0xC0) == 0x80
        at = at + inside
    return np.unique(at)


def chunks(text: bytes, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders, and the digest of every chunk as a 64-bit and a 32-bit number."""
    at = borders(text, mean)
    places = at.tolist()
    digests = b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(places, places[1:], strict=False)])
    halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    return at, halves[:, 0], halves[:, 1].astype(np.int32)


def keep_text(
    text: bytes, gone: np.ndarray, min_run: int, mean: int = MEAN_CHUNK
) -> tuple[bytes, int, int, np.ndarray]:
    """Text without repeated runs, number of chunks, number of removed chunks, places in ``gone`` of removed ones."""
    at, high, _ = chunks(text, mean)
    if not len(high):
        return text, 0, 0, np.empty(0, dtype=np.int64)
    first = np.zeros(len(high), dtype=bool)
    first[np.unique(high, return_index=True)[1]] = True
    repeated = ~first | np.isin(high, gone)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = at[ends] - at[starts] >= min_run
    kept, pos = [], 0
    for a, b in zip(at[starts[long]].tolist(), at[ends[long]].tolist(), strict=True):
        kept.append(text[pos:a])
        pos = b
    kept.append(text[pos:])
    removed = [high[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    places = np.flatnonzero(np.isin(gone, np.concatenate(removed))) if removed else np.empty(0, dtype=np.int64)
    return b"".join(kept), len(high), int((ends - starts)[long].sum()), places


def digest_rows(docs: DataFrame, mean: int) -> DataFrame:
    """(_id, _th, _h1, _h2): each distinct chunk of each document."""
    schema = T.StructType(
        [
            docs.schema["_id"],
            docs.schema["_th"],
            T.StructField("_h1", T.LongType()),
            T.StructField("_h2", T.IntegerType()),
        ]
    )

    def emit(batch: pa.RecordBatch, row: list, high: list, low: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate(row))
        ids, th = batch.column("_id").take(at), batch.column("_th").take(at)
        return pa.RecordBatch.from_arrays(
            [ids, th, pa.array(np.concatenate(high)), pa.array(np.concatenate(low))], names=schema.names
        )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, high, low, n = [], [], [], 0
            for i, text in enumerate(batch.column("_text")):
                if text.is_valid:
                    _, h1, h2 = chunks(text.as_buffer().to_pybytes(), mean)
                    own = np.unique(h1, return_index=True)[1]
                    row.append(np.full(len(own), i, dtype=np.int64))
                    high.append(h1[own])
                    low.append(h2[own])
                    n += len(own)
                if n >= ROWS_OUT:
                    yield emit(batch, row, high, low)
                    row, high, low, n = [], [], [], 0
            if n:
                yield emit(batch, row, high, low)

    return docs.mapInArrow(run, schema)


def dedup_chunks(
    df: DataFrame, doc_id: str, text: str, keep: Sequence[str] = (), mean: int = MEAN_CHUNK, min_run: int = MIN_RUN
) -> DataFrame:
    """``doc_id``, ``text`` without repeated passages, columns ``keep``, ``n_chunks``, ``n_removed`` and ``first_docs``.

    ``first_docs`` lists the documents that keep the passages which this one loses, null if it loses none to others."""
    kept = [f"_k{i}" for i in range(len(keep))]
    docs = only(df, doc_id, text, *keep).toDF("_id", "_text", *kept)
    docs = docs.withColumn("_th", F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.lit(0)))
    found = digest_rows(docs.select("_id", "_text", "_th"), mean)
    first = (
        found.groupBy("_h1", "_h2")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    later = found.join(first, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_first")))
    gone = (
        later.groupBy("_id", "_th")
        .agg(F.array_sort(F.collect_set(F.struct("_h1", "_first"))).alias("_pairs"))
        .select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), F.col("_pairs._h1").alias("_gone"), F.col("_pairs._first").alias("_firsts"))
    )
    joined = docs.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    schema = T.StructType(
        [
            docs.schema["_id"],
            T.StructField("_new", T.StringType()),
            *[docs.schema[k] for k in kept],
            T.StructField("n_chunks", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("first_docs", T.ArrayType(docs.schema["_id"].dataType)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                texts, n, removed, first = [], [], [], []
                for t, g, f in zip(*(batch.column(c) for c in ("_text", "_gone", "_firsts")), strict=True):
                    gone = g.values.to_numpy() if g.is_valid else np.empty(0, dtype=np.int64)
                    made = keep_text(t.as_buffer().to_pybytes(), gone, min_run, mean) if t.is_valid else (None, 0, 0, ())
                    texts.append(made[0])
                    n.append(made[1])
                    removed.append(made[2])
                    first.append(sorted(set(f.values.take(pa.array(made[3])).to_pylist())) if len(made[3]) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id"),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        *[batch.column(k) for k in kept],
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(first, pa.list_(batch.column("_firsts").type.value_type)),
                    ],
                    names=schema.names,
                )

    out = joined.select("_id", "_text", *kept, "_gone", "_firsts").mapInArrow(run, schema)
    return out.toDF(doc_id, text, *keep, "n_chunks", "n_removed", "first_docs")

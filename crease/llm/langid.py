"""Operator 8: language ID with string kernels.

Text is lower-cased, everything but letters becomes a blank, and all character
n-grams of one to three signs form a set (the blended spectrum, by presence),
hashed to 2**18 buckets.  The kernel of two texts is the size of their common
set over the root of the product of their sizes.  Landmark texts span a Nyström
approximation of it, on which one-versus-rest ridge regression is fitted.
Scoring multiplies a batch's presence matrix with the landmarks' and the result
with the regression's weights.

The model is fitted on the driver from about ``per_lang`` labelled rows of each
language, picked by a hash of the row, which come as sets of at most 2**18
numbers.  How many rows a language has is counted over all rows.  The broadcast
model has at most 2**18 x landmarks small floats.  Every row is scored over its
whole text where it lies: no shuffle.

A text is ``known`` if it looks like a learned language.  The score can't tell:
the languages' values for any text add up to 2 less their number, so the best is
never low when they are few.  Instead the n-grams count, with repeats, that
hardly any learned row of any language has.  Their share may exceed that of
nearly all learned rows of the language found (each compared with the other
rows) by ``STRANGE`` and a bit more in short texts, however many languages there
are.  Where rows of a language are too few to know one another, nothing is
rejected as that language.

Defined cases.  Null texts and texts without a letter get ``und`` with score 0
and aren't known, and so does every text when no labelled row has letters.  Rows without label
are not learned from.  Repeated rows count once in the fit.  Labels are names of
languages, a few hundred at most, as the model holds a column for each; one is
learned if a drawn text of it has letters.  Empty table: no rows.  Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only

BUCKET_BITS = 18
ORDERS = 3
PER_LANG = 250  # labelled rows of a language to fit on
LANDMARKS = 64  # in all, shared evenly by the languages
RIDGE = 1e-3
COMMON = 0.02  # share of a language's learned rows, two at least, that make an n-gram known
USUAL, STRANGE = 0.9, 0.05  # quantile of the learned rows' shares of unknown n-grams, and what a text may add
BATCH = 128  # documents in one matrix product
UNKNOWN = "und"
BLANK = 32


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point to the lower-case letter's code point, or to a blank."""
    points = (chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    return np.array([ord(c.lower()[0]) if c.isalpha() else BLANK for c in points], dtype=np.uint32)


@lru_cache(maxsize=1)
def scratch() -> np.ndarray:
    return np.zeros(1 << BUCKET_BITS, dtype=np.int64)


def buckets(text: str) -> np.ndarray:
    """Bucket of each n-gram of a text, with repeats; empty if it has no letter."""
    codes = folded()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    letter = codes != BLANK
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    letter[1:] |= letter[:-1]  # of several blanks the first stays
    codes = np.concatenate([[BLANK], codes[letter], [BLANK]]).astype(np.uint32)
    found, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(ORDERS):
        h = (h[: len(codes) - n] + codes[n:]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        found.append((h + np.uint32(n)) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS))
        h = h[: len(codes) - n - 1]
    return np.concatenate(found).astype(np.int64)


def n_distinct(found: np.ndarray) -> int:
    """Number of different buckets: of equal ones, the last writer's mark remains."""
    mark, order = scratch(), np.arange(len(found))
    mark[found] = order
    return int(np.count_nonzero(mark[found] == order))


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray  # bucket -> column of the presence matrix, or its width for buckets of no landmark
    landmarks: np.ndarray  # columns x landmarks, presence over the root of the landmark's size
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    common: np.ndarray  # bucket -> whether learned rows share it
    limits: np.ndarray  # share of unknown n-grams that is usual in each language

    def knows(self, found: np.ndarray, lang: int) -> bool:
        """Whether a text, given as its buckets, looks like the language."""
        unknown = 1 - np.count_nonzero(self.common[found]) / len(found)
        return bool(unknown <= self.limits[lang] + STRANGE + len(found) ** -0.5)

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """Languages' regression values, a row for each text given as its buckets."""
        width = len(self.landmarks)
        presence = np.zeros((len(texts), width + 1), dtype=np.float32)
        roots = np.ones(len(texts))
        for i, found in enumerate(texts):
            presence[i, self.column[found]] = 1
            roots[i] = max(1, n_distinct(found)) ** 0.5
        kernel = (presence[:, :width] @ self.landmarks) / roots[:, None]
        return kernel @ self.weights + self.bias


def familiar(sets: list[np.ndarray], labels: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that enough rows of some language hold, and the usual share of other buckets in each language's rows.

    A row is compared with the rows beside it: its own mark doesn't count."""
    counts = {g: np.zeros(1 << BUCKET_BITS, dtype=np.int32) for g in langs}
    for found, g in zip(sets, labels, strict=True):
        counts[g][found] += 1
    needed = {g: max(2, int(np.ceil(COMMON * labels.count(g)))) for g in langs}
    holders = sum((counts[g] >= needed[g]).astype(np.int32) for g in langs)
    unknown = {g: [] for g in langs}
    for found, g in zip(sets, labels, strict=True):
        lost = counts[g][found] == needed[g]  # known only with this row
        unknown[g].append(np.count_nonzero(holders[found] - lost == 0) / len(found))
    return holders > 0, np.array([np.quantile(unknown[g], USUAL) for g in langs])


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nyström features of labelled sets of buckets."""
    langs = sorted(set(labels))
    if not langs:
        return None
    own = {g: [i for i, x in enumerate(labels) if x == g] for g in langs}
    share = max(1, landmarks // len(langs))
    chosen = [i for g in langs for i in own[g][:share]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(1 << BUCKET_BITS, len(vocabulary), dtype=np.int32)
    column[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    marks = np.zeros((len(vocabulary), len(chosen)), dtype=np.float32)
    for k, i in enumerate(chosen):
        marks[column[sets[i]], k] = len(sets[i]) ** -0.5
    model = Model(langs, column, marks, np.eye(len(chosen)), np.zeros(len(chosen)), *familiar(sets, labels, langs))
    kernel = np.concatenate([model.margins(sets[a : a + BATCH]) for a in range(0, len(sets), BATCH)])
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.hstack([kernel @ root, np.ones((len(sets), 1))])
    targets = np.array([[1.0 if x == g else -1.0 for g in langs] for x in labels])
    gram = features.T @ features + ridge * len(sets) * np.diag([1.0] * (features.shape[1] - 1) + [0.0])
    solved = np.linalg.lstsq(gram, features.T @ targets, rcond=None)[0]
    model.weights, model.bias = root @ solved[:-1], solved[-1]
    return model


def fit(rows: DataFrame, text: str, lang: str, row_hash: Column, per_lang: int = PER_LANG) -> Model | None:
    """Model from a sample of the labelled rows; which rows, ``row_hash`` (a 64-bit hash) decides."""
    labelled = rows.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"), row_hash.alias("_hash"))
    labelled = labelled.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    counts = {r["_lang"]: r["n"] for r in labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    chance = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, per_lang / n)])[F.col("_lang")]
    drawn = F.shiftrightunsigned("_hash", 11) / float(1 << 53) < chance
    sample = labelled.where(drawn).dropDuplicates(["_lang", "_hash"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = [np.unique(buckets(t)).astype(np.int32) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), batch.column("_hash"), pa.array(sets, pa.list_(pa.int32()))],
                names=["_lang", "_hash", "_set"],
            )

    schema = T.StructType(
        [
            T.StructField("_lang", T.StringType()),
            T.StructField("_hash", T.LongType()),
            T.StructField("_set", T.ArrayType(T.IntegerType())),
        ]
    )
    found = [r for r in sample.mapInArrow(run, schema).collect() if r["_set"]]
    found.sort(key=lambda r: (r["_hash"], r["_lang"], r["_set"]))
    return fit_sets([np.array(r["_set"], dtype=np.int64) for r in found], [r["_lang"] for r in found])


def identify(df: DataFrame, text: str, keep: list[str], model: Model | None) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred``, ``score`` (0 to 1) and ``known``."""
    kept = [f"_k{i}" for i in range(len(keep))]
    source = only(df, *keep, text).toDF(*kept, "_text")
    schema = T.StructType(
        [
            *source.schema.fields[:-1],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("known", T.BooleanType()),
        ]
    )
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                found = [buckets(t or "") for t in batch.column("_text").to_pylist()]
                lettered = np.array([len(x) > 0 for x in found]) & (model is not None)
                pred, score = np.full(len(found), UNKNOWN, dtype=object), np.zeros(len(found))
                known = np.zeros(len(found), dtype=bool)
                if lettered.any():
                    texts = [x for x, y in zip(found, lettered, strict=True) if y]
                    margins = model.margins(texts)
                    best = margins.argmax(axis=1)
                    pred[lettered] = [model.langs[b] for b in best]
                    score[lettered] = np.clip((margins.max(axis=1) + 1) / 2, 0, 1)
                    known[lettered] = [model.knows(x, b) for x, b in zip(texts, best.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(known)],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score", "known")

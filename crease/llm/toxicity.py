"""Operator 11: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of any kind, their labels
unread, are the unlabelled rows.  A text's features are its words and the
beginnings of its words (``PREFIXES`` letters), hashed to 2**20 buckets; each
bucket counts by presence and by its share of the text's words (``SHARES``).

A linear classifier minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` of the logistic loss: the
negatives' part is the unlabelled rows' less what the positives among them
bring, and where a fit that is too close makes it negative, the step undoes it.
The prior is the share of positives among all labelled rows, unless given.

``BAGS`` classifiers are trained, each by one task of numpy code on the drawn
positives and its own bag of unlabelled texts; their weights are averaged.
Bounds: ``POSITIVES`` drawn rows and ``UNLABELLED`` in each bag, picked by a hash
of the row; how many rows there are is counted over all rows.  A classifier reads
at most ``FEATURES`` features, those that are surely (by ``SURE`` standard errors)
and most clearly more frequent among positives.  The broadcast model is 4 MB of columns and at most BAGS * FEATURES
weights.  Every row is scored over its whole text where it lies: no shuffle.

Defined cases.  Null, empty and letterless texts get the score of a text without
features.  Rows whose label is null, or without labelled row, are unlabelled; of
several labels of an id the largest counts.  Repeated rows count once in the
draw.  Without positives (or without unlabelled rows) there is nothing to learn
and every score is 0.  A null id is never labelled.  Empty table: no rows.  Only
the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only, stored
from crease.llm.langid import BLANK, folded

BUCKET_BITS = 20
PREFIXES = (4, 7)  # lengths of word beginnings that count besides the whole word
LONGEST = 24  # letters of the longest word that counts as a whole
SHARES = (0.003, 0.01, 0.03)  # of a text's words, for buckets met twice or more
LEVELS = 1 + len(SHARES)
POSITIVES, UNLABELLED, BAGS = 3000, 6000, 3
FEATURES = 2048
LEAST = 4  # positives of a bag that a feature must occur in
SURE = 3.0
STEPS, RATE, DECAY = 300, 0.02, 2e-3
CLIP = 4.0
DEFAULT_PRIOR = 0.1  # where every labelled row is positive, so that labels tell no share


def tokens(text: str) -> tuple[np.ndarray, int]:
    """Buckets of the words and word beginnings of a text, with repeats, and its number of words."""
    codes = folded()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    letter = codes != BLANK
    if not letter.any():
        return np.empty(0, dtype=np.int64), 0
    codes = np.concatenate([[BLANK], codes, [BLANK]]).astype(np.uint32)
    blank = codes == BLANK
    at = np.flatnonzero(~blank[1:] & blank[:-1]) + 1  # first letters
    words, found = len(at), []
    h = np.full(words, 1, dtype=np.uint32)
    for n in range(1, LONGEST + 2):
        c = codes[at]
        h = (h + c) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        ended = c == BLANK
        counted = h if PREFIXES[0] <= n <= PREFIXES[1] else h[ended]
        found.append((counted + np.uint32(n)) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS))
        at, h = at[~ended] + 1, h[~ended]
        if not len(at):
            break
    return np.concatenate(found).astype(np.int64), words


def levels(counts: np.ndarray, words: int) -> np.ndarray:
    """Which levels buckets of these counts reach: presence, then shares of the words (buckets x levels)."""
    share = counts / max(1, words)
    return np.column_stack([counts >= 1, *[(counts >= 2) & (share >= s) for s in SHARES]])


def features(text: str) -> np.ndarray:
    """Features of a text: bucket * LEVELS + level."""
    found, words = tokens(text)
    buckets, counts = np.unique(found, return_counts=True)
    row, level = np.nonzero(levels(counts, words))
    return (buckets[row] * LEVELS + level).astype(np.int32)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk at the rows' values: ``prior * R_p(+)`` and ``R_u(-) - prior * R_p(-)``."""
    as_negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(prior * np.logaddexp(0, -positive).mean()), float(as_negative)


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step follows for each row's value: the risk's slope, or that which undoes a negative second part."""
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    negative_p, negative_u = -prior * p / len(p), u / len(u)
    if risk(positive, unlabelled, prior)[1] < 0:
        return -negative_p, -negative_u
    return prior * (p - 1) / len(p) + negative_p, negative_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a classifier fitted on feature sets."""
    size = LEVELS << BUCKET_BITS
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    met = np.flatnonzero(in_p >= min(LEAST, len(positive)))
    in_p, in_u = in_p[met] + 0.5, in_u[met] + 0.5
    rate_p, rate_u = in_p / (len(positive) + 1), in_u / (len(unlabelled) + 1)
    ratio = np.log(rate_p / rate_u) - SURE * np.sqrt(1 / in_p + 1 / in_u)
    best = np.argsort(-rate_p * ratio, kind="stable")[:FEATURES]
    best = np.sort(best[ratio[best] > 0])
    chosen, scale = met[best], np.minimum(ratio[best], CLIP)
    column = np.full(size, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(chosen)), dtype=np.float32)
        for i, found in enumerate(sets):
            at = column[found]
            at = at[at >= 0]
            out[i, at] = scale[at]
        return out

    mp, mu = matrix(positive), matrix(unlabelled)
    at = np.zeros(len(chosen) + 1)
    at[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, STEPS + 1):  # Adam
        w, bias = at[:-1].astype(np.float32), at[-1]
        sp, su = slopes(np.clip(mp @ w + bias, -30, 30), np.clip(mu @ w + bias, -30, 30), prior)
        slope = np.append(sp.astype(np.float32) @ mp + su.astype(np.float32) @ mu + DECAY * w, sp.sum() + su.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        at -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return chosen, at[:-1] * scale, float(at[-1])


@dataclass
class Model:
    column: np.ndarray  # bucket -> row of the weights, the last where no classifier reads it
    weights: np.ndarray  # rows x levels
    bias: float

    def score(self, text: str) -> float:
        found, words = tokens(text)
        at = self.column[found]
        rows, counts = np.unique(at[at < len(self.weights)], return_counts=True)
        z = self.bias + float((self.weights[rows] * levels(counts, words)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def average(fits: list[tuple[np.ndarray, np.ndarray, float]]) -> Model:
    """One linear model whose value is the mean of the classifiers' values."""
    buckets = np.unique(np.concatenate([chosen // LEVELS for chosen, _, _ in fits]))
    column = np.full(1 << BUCKET_BITS, len(buckets), dtype=np.int32)
    column[buckets] = np.arange(len(buckets))
    weights = np.zeros((len(buckets), LEVELS))
    for chosen, w, _ in fits:
        weights[column[chosen // LEVELS], chosen % LEVELS] += w / len(fits)
    return Model(column, weights, float(np.mean([bias for _, _, bias in fits])))


def drawn_features(draw: DataFrame, rows: DataFrame) -> DataFrame:
    """(_bags, _positive, _hash, _set) of the drawn rows' texts, found again by their hash."""
    texts = rows.join(F.broadcast(draw), "_hash").dropDuplicates(["_hash", "_positive"]).select("_bags", "_positive", "_hash", "_text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = [features(t or "").tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=[*batch.schema.names[:3], "_set"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:3], T.StructField("_set", T.BinaryType())]))


FIT = "_bag int, chosen array<int>, weights array<double>, bias double"


def fit(
    rows: DataFrame, text: str, key: str, positive_keys: DataFrame, prior: float | None = None,
    n_positive: int = POSITIVES, n_unlabelled: int = UNLABELLED, n_bags: int = BAGS, labelled: tuple[int, int] | None = None,
) -> Model | None:
    """Model from texts that may be learned from; ``positive_keys`` (one column) names the confirmed positives.

    ``labelled``: numbers of positive and of all labelled rows, which give the prior."""
    rows = only(rows, key, text).toDF("_key", "_text").withColumn("_hash", F.xxhash64("_key", "_text"))
    keys = positive_keys.toDF("_key").where("_key is not null").distinct().withColumn("_positive", F.lit(True))
    known = rows.select("_key", "_hash").join(keys, "_key", "left").select("_hash", F.col("_positive").isNotNull().alias("_positive"))
    known = stored(known, "toxic-rows")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("_positive").alias("p")).first()
    if not n["p"] or n["n"] == n["p"]:
        return None
    if prior is None:
        p, m = labelled or (0, 0)
        prior = p / m if 0 < p < m else DEFAULT_PRIOR

    def chance(seed: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("_hash", F.lit(seed)), 11) / float(1 << 53)

    every = F.array(*[F.lit(b) for b in range(n_bags)])
    positives = known.where(F.col("_positive") & (chance(-1) < n_positive / n["p"])).select("_hash", every.alias("_bags"), "_positive")
    # positives are also among the unlabelled rows, as in the whole corpus
    bags = F.array_compact(F.array(*[F.when(chance(b) < n_unlabelled / n["n"], b) for b in range(n_bags)]))
    others = known.select("_hash", bags.alias("_bags"), F.lit(False).alias("_positive")).where(F.size("_bags") > 0)
    draw = positives.distinct().limit(2 * n_positive).unionByName(others.distinct().limit(2 * n_bags * n_unlabelled))
    sets = stored(drawn_features(stored(draw, "toxic-draw"), rows), "toxic-sets")
    bagged = sets.select(F.explode("_bags").alias("_bag"), "_positive", "_hash", "_set")

    def one(key: tuple, bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values(["_positive", "_hash"])
        found = [np.frombuffer(s, dtype=np.int32) for s in bag["_set"]]
        mark = bag["_positive"].tolist()
        p, u = [f for f, m in zip(found, mark, strict=True) if m], [f for f, m in zip(found, mark, strict=True) if not m]
        out = [(key[0], *train(p, u, prior))] if p and u else []
        return pd.DataFrame([(b, c.tolist(), w.tolist(), z) for b, c, w, z in out], columns=["_bag", "chosen", "weights", "bias"])

    fits = sorted(bagged.groupBy("_bag").applyInPandas(one, FIT).collect(), key=lambda r: r["_bag"])
    if not fits:
        return None
    return average([(np.array(r["chosen"], dtype=np.int64), np.array(r["weights"], dtype=float), r["bias"]) for r in fits])


def scored(df: DataFrame, text: str, keep: list[str], model: Model | None) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` (0 to 1)."""
    source = only(df, *keep, text).toDF(*[f"_k{i}" for i in range(len(keep))], "_text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in batches:
            score = [model.score(t or "") if model else 0.0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, "score")


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, toxic: str, may_learn: Column) -> Model | None:
    """Model of the rows for which ``may_learn`` (over ``_key``, the id) holds, in documents and in labels alike."""
    marks = only(labels, label_id, toxic).toDF("_key", "_toxic").where(F.col("_toxic").isNotNull() & may_learn)
    marks = stored(marks.groupBy("_key").agg(F.max("_toxic").alias("_toxic")), "toxic-labels")
    n = marks.agg(F.count_if(F.col("_toxic") == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    rows = only(docs, doc_id, text).toDF("_key", "_text").where(may_learn)
    return fit(rows, "_text", "_key", marks.where("_toxic = 1").select("_key"), labelled=(n["p"], n["n"]))


"""Operator 1: quality by an interpolated modified Kneser-Ney n-gram model.

The model counts character n-grams of five of all trusted texts, so that it
judges words and where they meet, and its tables grow with the text.  Counts,
continuation counts, sums over contexts and counts of counts are tables spread
by n-gram; discounts are three numbers for each model and order.

Each language has two models, fitted across: texts fall into two folds by their
hash, and a text is scored by the model of the other fold's trusted texts.  So
no text, trusted or not, is scored by a model that saw it or an equal one, and
the threshold, the language's quantile ``quantile`` of the trusted documents'
perplexities, is a held-out one.  Where all trusted texts of a language fall
into one fold, both models count them.

Documents are dealt to blocks of about ``BLOCK_CHARS`` characters of one
model.  A block asks for its distinct n-grams, all blocks' requests meet the
sharded counts of each order in joins, and the answers go back to the block,
which scores its documents.  Texts travel compressed.  So an n-gram in all documents is asked for once in
a block, and no count table is gathered anywhere.  Rows equal in id and text
that would fill a block are scored once.

Defined cases.  Null and empty texts have no perplexity and aren't kept.
Documents of a language without trusted text have no perplexity or threshold
and are kept, as nothing speaks against them; a null language is a language of
its own.  Several labels of a document: trusted if one says so.  Rows of one id
share its trust; repeated rows are scored alike.  Empty tables: no rows, or
nothing trusted.  Only the named columns are read, so extra columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only
from crease.llm.common import stored_freed as stored

ORDER = 5
QUANTILE = 0.99
FOLDS = 2
BLOCK_CHARS = 32_000_000
BROADCAST_ROWS = 1_000_000  # rows of ids or languages that may be broadcast (about 16 MB); more are shuffled
LOT_CHARS = 2_000_000  # characters counted at a time in a task
START, END = 2, 3  # control characters around a text


def padded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts with signs for start and end, where n-grams start, and how many each text has."""
    lead, sizes = chr(START) * (order - 1), np.array([len(t) + 1 for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join([lead + t + chr(END) for t in texts]).encode("utf-32-le"), dtype="<u4")
    shift = np.arange(len(texts), dtype=np.int64) * (order - 1)
    return codes, np.arange(sizes.sum(), dtype=np.int64) + np.repeat(shift, sizes), sizes


def gram_keys(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit number for the n-gram at each place: 21 bits a character up to order 3, else a polynomial digest."""
    wide, n = codes.astype(np.uint64), len(codes) - order + 1
    step = np.uint64(1 << 21) if order <= 3 else np.uint64(0x9E3779B97F4A7C15)
    key = wide[:n].copy()
    for k in range(1, order):
        key *= step
        key += wide[k : n + k]
    return key


def gram_texts(codes: np.ndarray, places: np.ndarray, order: int) -> list[str]:
    """The n-grams at some places."""
    wide = np.stack([codes[places + k] for k in range(order)], axis=1).astype("<u4")
    text = wide.tobytes().decode("utf-32-le")
    return [text[i : i + order] for i in range(0, len(text), order)]


def distinct_grams(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of some texts and how often each occurs."""
    texts = [t for t in texts if t]
    if not texts:
        return [], np.empty(0, dtype=np.int64)
    codes, places, _ = padded(texts, order)
    keys = gram_keys(codes, order)[places]
    rank = np.argsort(keys)
    keys = keys[rank]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return gram_texts(codes, places[rank[new]], order), np.diff(np.append(new, len(keys)))


def portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lots of about ``LOT_CHARS`` characters."""
    lot, chars = [], 0
    for t in texts:
        lot.append(t)
        chars += len(t)
        if chars >= LOT_CHARS:
            yield lot
            lot, chars = [], 0
    if lot:
        yield lot


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


# -- the model


def gram_counts(trusted: DataFrame, order: int) -> DataFrame:
    """(_model, gram, c) of trusted (_model, _text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column("_model").to_pylist()
            texts = batch.column("_text").to_pylist()
            for name in sorted(set(names)):
                own = [t for t, g in zip(texts, names, strict=True) if g == name]
                for part in portions(own):
                    grams, counts = distinct_grams(part, order)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                        names=["_model", "gram", "c"],
                    )

    return trusted.mapInArrow(run, "_model string, gram string, c long").groupBy("_model", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Count tables of all orders, spread by n-gram."""

    def __init__(self, trusted: DataFrame, order: int):
        self.order = order
        self.counts, self.contexts, self.discounts = {}, {}, {}
        for n in range(order, 0, -1):
            if n == order:
                counts = gram_counts(trusted, order)
            else:  # in how many ways it is preceded
                longer = self.counts[n + 1]
                counts = longer.groupBy("_model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            self.counts[n] = stored(counts, f"kn-counts-{n}")
            self.discounts[n] = self._discounts(self.counts[n])
            of = lambda c: F.sum(F.when(F.col("c") == c, 1).otherwise(0))
            context = F.expr(f"substring(gram, 1, {n - 1})").alias("context")
            sums = self.counts[n].groupBy("_model", context).agg(
                F.sum("c").alias("total"),
                of(1).alias("ones"),
                of(2).alias("twos"),
                F.sum(F.when(F.col("c") >= 3, 1).otherwise(0)).alias("more"),
            )
            self.contexts[n] = stored(sums, f"kn-contexts-{n}")
        signs = self.counts[1].groupBy("_model").agg((F.count(F.lit(1)) + 1).alias("signs"))
        self.signs = small_or_shuffled(stored(signs, "kn-signs"))  # a row for each model, as contexts of order 1 are
        self.contexts[1] = small_or_shuffled(self.contexts[1])

    @staticmethod
    def _discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
        """Three discounts for each model from its counts of counts."""
        found = counts.where("c <= 4").groupBy("_model", "c").agg(F.count(F.lit(1)).alias("n")).collect()
        out = {}
        for name in {r["_model"] for r in found}:
            n = {r["c"]: r["n"] for r in found if r["_model"] == name}
            n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            out[name] = tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))
        return out

    def _discount(self, n: int) -> list[Column]:
        """Discounts of the row's model."""
        known = [(name, d) for name, d in sorted(self.discounts[n].items())] or [("", (0.5, 1.0, 1.5))]
        maps = [F.create_map(*[F.lit(x) for name, d in known for x in (name, float(d[k]))]) for k in range(3)]
        return [F.coalesce(m[F.col("_model")], F.lit(0.5 * (k + 1))) for k, m in enumerate(maps)]

    def scored(self, wanted: DataFrame) -> DataFrame:
        """(_model, gram, logp) of distinct wanted n-grams in models that exist."""
        rows = wanted.join(self.signs, "_model").withColumn("p", 1.0 / F.col("signs"))
        for n in range(1, self.order + 1):
            rows = rows.withColumn("_key", F.expr(f"right(gram, {n})")).withColumn("_context", F.expr(f"substring(_key, 1, {n - 1})"))
            counts = self.counts[n].select("_model", F.col("gram").alias("_key"), "c")
            contexts = self.contexts[n].withColumnRenamed("context", "_context")
            rows = rows.join(counts, ["_model", "_key"], "left").join(contexts, ["_model", "_context"], "left")
            d1, d2, d3 = self._discount(n)
            count = F.coalesce("c", F.lit(0))
            taken = F.when(count == 0, 0.0).when(count == 1, d1).when(count == 2, d2).otherwise(d3)
            held = d1 * F.col("ones") + d2 * F.col("twos") + d3 * F.col("more")
            p = F.when(F.col("total").isNull(), F.col("p")).otherwise((count - taken + held * F.col("p")) / F.col("total"))
            rows = rows.select("_model", "gram", p.alias("p"))
        return rows.select("_model", "gram", F.log("p").alias("logp"))


# -- documents


def compressed(docs: DataFrame) -> DataFrame:
    """Documents with ``_text`` compressed, one by one."""
    schema = T.StructType([T.StructField("_text", T.BinaryType()) if f.name == "_text" else f for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]):
        squeeze = zstandard.ZstdCompressor().compress
        for batch in batches:
            texts = pa.array([squeeze(t.as_buffer()) for t in batch.column("_text")], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("_text"), "_text", texts)

    return docs.mapInArrow(run, schema)


def plain(texts: pa.ChunkedArray) -> Iterator[str]:
    """Compressed texts, one by one."""
    open_ = zstandard.ZstdDecompressor().decompress
    for t in texts:
        yield open_(t.as_buffer()).decode()


def _same(row: DataFrame, key: DataFrame) -> Column:
    """Whether rows are equal in id, model and text."""
    return row["_id"].eqNullSafe(key["_same_id"]) & (row["_model"] == key["_same_model"]) & (row["_key"] == key["_same_key"])


def _as_keys(rows: DataFrame, *more: str) -> DataFrame:
    named = [F.col(c).alias(f"_same{c}") for c in ("_id", "_model", "_key")]
    return rows.select(*named, *more)


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(_id, _model, perplexity) of documents (_id, _model, _text) with text; rows that repeat often are scored once."""
    docs = docs.withColumn("_key", F.xxhash64("_text"))
    counted = docs.groupBy("_id", "_model", "_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("_text")).alias("chars"))
    often = counted.where((F.col("n") > 1) & (F.col("n") * F.col("chars") > BLOCK_CHARS // 16))
    often = small_or_shuffled(stored(_as_keys(often), "kn-often"))
    if often.isEmpty():
        return _scored(docs, model).drop("_key")
    again = docs.join(often, _same(docs, often), "left_semi")
    once = again.dropDuplicates(["_id", "_model", "_key"])
    scored = stored(_scored(docs.join(often, _same(docs, often), "left_anti").unionByName(once), model), "kn-scored-once")
    known = small_or_shuffled(stored(_as_keys(scored.join(often, _same(scored, often), "left_semi"), "perplexity"), "kn-scored-often"))
    rest = scored.join(often, _same(scored, often), "left_anti").drop("_key")
    return rest.unionByName(again.join(known, _same(again, known)).select("_id", "_model", "perplexity"))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(_id, _model, _key, perplexity) of documents (_id, _model, _text, _key), block by block."""
    order = model.order
    chars = docs.groupBy("_model").agg(F.ceil(F.sum(F.length("_text")) / F.lit(BLOCK_CHARS)).cast("long").alias("_blocks"))
    blocks = small_or_shuffled(stored(chars, "kn-blocks"))  # a row for each model
    dealt = compressed(docs).join(blocks, "_model").withColumn("_block", F.pmod(F.xxhash64("_id", "_key"), "_blocks")).drop("_blocks")

    def ask(group: pa.Table) -> pa.Table:
        grams = sorted({g for lot in portions(plain(group["_text"])) for g in distinct_grams(lot, order)[0]})
        same = lambda c: pa.array([group[c][0].as_py()] * len(grams), group[c].type)
        return pa.table({"_model": same("_model"), "_block": same("_block"), "gram": pa.array(grams, pa.string())})

    asked = dealt.groupBy("_model", "_block").applyInArrow(ask, "_model string, _block long, gram string")
    asked = stored(asked, "kn-asked")
    known = stored(model.scored(asked.select("_model", "gram").distinct()), "kn-known")
    answers = asked.join(known, ["_model", "gram"])
    schema = T.StructType(
        [docs.schema["_id"], docs.schema["_model"], docs.schema["_key"], T.StructField("perplexity", T.DoubleType())]
    )

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = "".join(answers["gram"].to_pylist())
        logp = np.asarray(answers["logp"])
        codes = np.frombuffer(known.encode("utf-32-le"), dtype="<u4")
        keys = gram_keys(codes, order)[::order] if len(codes) else np.empty(0, dtype=np.uint64)
        rank = np.argsort(keys)
        keys, logp = keys[rank], logp[rank]
        found = [np.empty(0)]
        for lot in portions(plain(texts["_text"])):
            own, places, sizes = padded(lot, order)
            if len(keys):
                each = logp[np.searchsorted(keys, gram_keys(own, order)[places])]
                found.append(np.exp(-np.add.reduceat(each, np.cumsum(sizes) - sizes) / sizes))
            else:
                found.append(np.full(len(lot), np.nan))
        found = np.concatenate(found)
        return pa.table({**{c: texts[c] for c in ("_id", "_model", "_key")}, "perplexity": pa.array(found, pa.float64(), mask=np.isnan(found))})

    keyed = dealt.select("_id", "_model", "_key", "_text", "_block").groupBy("_model", "_block")
    return keyed.cogroup(answers.groupBy("_model", "_block")).applyInArrow(score, schema)


def judge(
    df: DataFrame,
    doc_id: str,
    text: str,
    lang: str,
    labels: DataFrame,
    label_id: str,
    is_trusted: Column,
    order: int = ORDER,
    quantile: float = QUANTILE,
) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, ``threshold`` and ``kept`` of every row; ``is_trusted`` reads ``labels``."""
    docs = only(df, doc_id, lang, text).toDF("_id", "_lang", "_text")
    no_lang = "\x00"
    docs = docs.withColumn("_lang", F.coalesce("_lang", F.lit(no_lang)))
    fold = F.pmod(F.xxhash64("_text"), F.lit(FOLDS))
    full = docs.where(F.length("_text") > 0).withColumn("_fold", fold).withColumn("_model", F.concat(F.col("_fold").cast("string"), "_lang"))
    ids = labels.where(is_trusted).select(F.col(f"`{label_id}`").alias("_id")).where("_id is not null").distinct()
    ids = small_or_shuffled(stored(ids, "kn-trusted"))

    trusted = full.join(ids, "_id", "left_semi")
    folds = trusted.groupBy("_lang").agg((F.count_distinct("_fold") == 1).alias("_alone"))
    folds = small_or_shuffled(stored(folds, "kn-folds"))  # a row for each language
    every_fold = F.array(*[F.lit(f) for f in range(FOLDS)])
    learning = F.filter(every_fold, lambda f: F.col("_alone") | (f != F.col("_fold")))
    taught = trusted.join(folds, "_lang").select("_lang", F.explode(learning).alias("_fold"), "_text")
    model = Model(taught.select(F.concat(F.col("_fold").cast("string"), "_lang").alias("_model"), "_text"), order)

    found = perplexities(full.select("_id", "_model", "_text"), model).withColumn("_lang", F.expr("substring(_model, 2)")).drop("_model")
    scored = stored(found, "kn-scored")
    of_trusted = scored.join(ids, "_id", "left_semi")
    limits = of_trusted.groupBy("_lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    judged = scored.join(small_or_shuffled(stored(limits, "kn-limits")), "_lang", "left")  # a row for each language
    bare = docs.where("_text is null or length(_text) = 0").select("_id", "_lang", F.lit(None).cast("double").alias("perplexity"))
    every = judged.withColumn("_bare", F.lit(False)).unionByName(bare.withColumn("_bare", F.lit(True)), allowMissingColumns=True)
    kept = F.when(F.col("_bare"), F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return every.select(
        F.col("_id").alias(doc_id),
        F.when(F.col("_lang") != no_lang, F.col("_lang")).alias(lang),
        "perplexity",
        "threshold",
        kept.alias("kept"),
    )

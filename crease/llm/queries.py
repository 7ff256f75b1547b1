"""Registered queries of the training-data operators: name -> (run, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm import annsearch, bpe, centroids, chunkdedup, graphdedup, jaccard, langid, linededup, merkle, packing, quality, sharding, toxicity
from crease.llm.common import table, unsigned_crc32


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled good, and whether it passes."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, "doc_id", "text", "lang", labels, "doc_id", F.col("quality") == 1)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and the kept vector of all embeddings at a cosine of at least 0.95."""
    return graphdedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of at least 0.9."""
    docs = table(spark, sf_dir, "documents")
    return jaccard.jaccard_components(docs, "doc_id", "text", words=3, num=9, den=10)


SEQUENCE = 1024
END_ID = 2


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    found = packing.pieces(docs, "doc_id", "text", public.path("byte_bpe_50k.json"), public.PATTERN, END_ID, SEQUENCE)
    return packing.pack(found, SEQUENCE)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in as few 1024-token sequences as best-fit with exchange reaches."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the three-line windows that occurred before."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector with an id divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return annsearch.search(vectors, "vec_id", "embedding", F.col("_id") % 20 == 0, k=20)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by the bounded-load ring; row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, "doc_id", ["size", "text_crc32"], n_shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that a language model may not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> langid.Model | None:
    return langid.fit(docs.where(~held_out()), "text", "lang", F.xxhash64("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, "text", ["doc_id"], language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that another document or an earlier place holds."""
    return chunkdedup.dedup_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text to ids and back; digests of both."""
    import public_tokenizers as public

    ranks = public.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    ids = bpe.encode(docs, "text", ["doc_id"], ranks, public.PATTERN).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    back = bpe.decode(ids, "ids", ["doc_id", "n_tokens", "ids_sha256"], ranks, public.PATTERN)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def toxic_held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels a toxicity model may not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


TOXIC_SCORE = 0.3


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from confirmed toxic and unlabelled documents outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, "doc_id", "text", labels, "doc_id", "toxic", ~toxic_held_out("_key"))
    return toxicity.scored(docs, "text", ["doc_id"], model).select(
        "doc_id",
        toxic_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC_SCORE, 1).otherwise(0).alias("predicted"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its language's hash tree, with its proof, checked against a tampered copy."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.manifest(docs, "doc_id", fields, "lang", {"text": merkle.tampered_text()})


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-component vectors in 16 clusters after three exact integer rounds."""
    vectors = table(spark, sf_dir, "embeddings")
    found, centres = centroids.cluster(vectors, "vec_id", "embedding", k=16, rounds=3, dims=64, scale=64)
    return centroids.with_digest(found, centres)


QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_near_dedup": (op2_near_dedup, None),
    "op3_jaccard_join": (op3_jaccard_join, None),
    "op4_packing": (op4_packing, None),
    "op8_language_id": (op8_language_id, None),
    "op9_substring_dedup": (op9_substring_dedup, None),
    "op10_bpe": (op10_bpe, None),
    "op5_line_dedup": (op5_line_dedup, linededup.ORACLE_SQL),
    "op6_nearest": (op6_nearest, None),
    "op7_sharding": (op7_sharding, None),
    "op11_toxicity": (op11_toxicity, None),
    "op12_merkle": (op12_merkle, merkle.ORACLE_SQL),
    "op13_centroids": (op13_centroids, centroids.oracle_sql()),
}

"""The registered queries on the smallest tables: columns, rows, and what their contracts fix."""

from __future__ import annotations

import hashlib
import zlib

import __spark_entry__ as entry
import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": ["doc_id", "lang", "perplexity", "threshold", "kept"],
    "op2_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op3_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_line_dedup": ["doc_id", "text", "n_lines", "n_removed"],
    "op6_nearest": ["query_id", "rank", "vec_id", "score"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_substring_dedup": ["doc_id", "text", "n_chunks", "n_removed", "first_docs"],
    "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def results(spark):
    queries = entry.queries()
    return lambda name: queries[name](spark, SF)


def test_all_are_registered():
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["op1_quality", "op3_jaccard_join", "op5_line_dedup", "op8_language_id", "op9_substring_dedup", "op11_toxicity", "op12_merkle"])
def test_one_row_for_each_document(results, documents, name):
    df = results(name)
    assert df.columns == COLUMNS[name]
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(documents)


def test_sharding(results, documents):
    df = results("op7_sharding")
    assert df.columns == COLUMNS["op7_sharding"]
    rows = df.collect()
    for r in rows:
        text = documents[r.doc_id]["text"].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(40)}
    assert all(v == list(range(5)) for v in slots.values())


def test_held_out_fold(results):
    for r in results("op8_language_id").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_bpe_digests(results, documents):
    import public_tokenizers as public
    import tiktoken
    from crease.llm.bpe import read_ranks

    ranks = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = results("op10_bpe")
    assert df.columns == COLUMNS["op10_bpe"]
    for r in df.collect():
        text = documents[r.doc_id]["text"]
        ids = library.encode_ordinary(text)
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), want, hashlib.sha256(text.encode()).hexdigest())


def test_packing(results, documents):
    df = results("op4_packing")
    assert df.columns == COLUMNS["op4_packing"]
    assert {r.doc_id for r in df.collect()} == set(documents)


def test_vectors(results):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids, points = np.asarray(table["vec_id"]), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    links = results("op2_near_dedup")
    assert links.columns == COLUMNS["op2_near_dedup"] and links.count() == len(ids)
    near = results("op6_nearest")
    assert near.columns == COLUMNS["op6_nearest"]
    rows, hits = near.collect(), 0
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert len(rows) == 20 * len(asked)
    place = {v: k for k, v in enumerate(ids.tolist())}
    for q in asked:
        scores = points @ points[place[q]]
        scores[place[q]] = -np.inf
        hits += len({ids[k] for k in np.argsort(-scores)[:20]} & {r.vec_id for r in rows if r.query_id == q})
    assert hits >= 0.9 * len(rows)

"""Operators that place rows or model them: 1, 4, 7."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from crease.llm import packing, quality, sharding
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of

JSON_FILE = public.path("byte_bpe_50k.json")


# -- 7


def check_shards(rows, n_shards, at_most_apart=1):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(n_shards))
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= at_most_apart
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sharding_of_hard_rows(hard_docs, hard_rows, clashing, no_docs):
    found = sharding.assign_shards(hard_docs, "doc_id", ["text", "n_chars"], 5)
    rows = found.collect()
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(repr((r[0], r[1])) for r in hard_rows)
    check_shards(rows, 5)
    assert rows_of(sharding.assign_shards(clashing, "doc_id", ["text", "n_chars"], 5)) == rows_of(found)
    assert sharding.assign_shards(no_docs, "doc_id", ["text"], 5).count() == 0


def test_a_repeated_row_may_hold_a_third(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 64)
    one = spark.range(1500).select((F.col("id") * 0).alias("key"), F.lit("same").alias("x"))
    rest = spark.range(3000).select(F.col("id").alias("key"), F.lit("other").alias("x"))
    rows = sharding.assign_shards(one.union(rest), "key", ["x"], 40).collect()
    assert len(rows) == 4500
    check_shards(rows, 40)


def test_ring_moves_few_rows():
    rng = np.random.default_rng(0)
    counts = collections.Counter((rng.integers(0, 1 << 16, 300_000)).tolist())

    def owners(n, load):
        return {(c, k): s for c, a, b, s, _ in sharding.fill(counts, n, load_factor=load) for k in range(a, b)}

    for load, most in ((1.0, 0.10), (1.25, 0.05)):  # the least possible is 1 / 41
        before, after = owners(40, load), owners(41, load)
        assert sum(before[x] != after[x] for x in before) / len(before) < most


def test_no_shard_above_its_bound():
    counts = {5: 900, 70: 30, 40_000: 70}  # one cell holds most rows
    load = collections.Counter()
    for _, a, b, s, _ in sharding.fill(counts, 10, load_factor=1.25):
        load[s] += b - a
    assert sum(load.values()) == 1000 and max(load.values()) <= 125


# -- 4


def test_vocabulary_gives_the_tokenizers_ids(hard_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON_FILE)
    tokenizer.encode_special_tokens = True
    encode = packing.word_ids(JSON_FILE, public.PATTERN)
    for text in [r[1] for r in hard_rows if r[1]] + ["a <|endoftext|> b", "x　 y\t\tz "]:
        ids = np.frombuffer(encode(text), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_get_the_tokenizers_ids_by_its_defaults(hard_rows):
    from tokenizers import Tokenizer

    tokenizer, encode, end = Tokenizer.from_file(JSON_FILE), packing.text_ids(JSON_FILE, public.PATTERN), "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end}", f"x{end}'s 12{end}\n\n", f"<|{end}|>", "<|endoftext |>", f"  {end}  über", end[:-1], f"a{end[:-1]}{end}"]
    for text in [r[1] for r in hard_rows if r[1]] + texts:
        ids = np.frombuffer(encode(text), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cut(n):
    found = packing.cut(n, 1024)
    assert found[0][0] == 0 and sum(x for _, x in found) == n
    assert all(length == 1024 for _, length in found[1:]) and 1 <= found[0][1] <= 1024
    assert all(a + x == b for (a, x), (b, _) in zip(found, found[1:], strict=False))


def exact_bins(sizes, capacity):
    """Least number of bins, by trying every placement."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [b + sizes[i] * (j == k) for j, b in enumerate(bins)])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_least_number():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 31, rng.integers(1, 9))
        least = exact_bins(sorted(sizes.tolist(), reverse=True), 30)
        bound = packing.lower_bound(np.bincount(sizes, minlength=31), 30)
        bins, offsets = packing.best_fit_decreasing(sizes, 30)
        assert bound <= least <= bins.max() + 1
        for b in set(bins.tolist()):
            own = np.argsort(offsets[bins == b])
            ends = np.cumsum(sizes[bins == b][own])
            assert ends[-1] <= 30 and (offsets[bins == b][own] == ends - sizes[bins == b][own]).all()
    assert packing.lower_bound(np.zeros(31, dtype=np.int64), 30) == 0


def check_packing(rows, capacity):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_exchange_comes_near_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(1, 1025, 4000))]
    items = spark.createDataFrame(rows, "id long, length long")
    found = packing.pack(items, 1024, items_per_task=150)
    got = found.collect()
    assert sorted((r.id, r.length) for r in got) == rows
    used, certified = check_packing(got, 1024), packing.certificate(found, 1024)
    alone = 0
    for at in range(0, 4000, 150):
        bins, _ = packing.best_fit_decreasing(np.array([x for _, x in rows[at : at + 150]]), 1024)
        alone += bins.max() + 1
    assert certified["sequences"] == used and certified["bound"] <= used <= 1.02 * certified["bound"] and used < alone


def test_packing_of_hard_rows(hard_docs, hard_rows, clashing, no_docs):
    find = lambda df: packing.pieces(df, "doc_id", "text", JSON_FILE, public.PATTERN, 2, 64)
    pieces = find(hard_docs)
    encode = packing.word_ids(JSON_FILE, public.PATTERN)
    want = []
    for r in hard_rows:
        ids = encode(r[1] or "") + b"\x02\0\0\0"
        for k, (a, n) in enumerate(packing.cut(len(ids) // 4, 64)):
            want.append(repr((r[0], k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]))))
    assert sorted(repr(tuple(r)) for r in pieces.collect()) == sorted(want)
    check_packing(packing.pack(pieces, 64, 100).collect(), 64)
    assert rows_of(find(clashing)) == rows_of(pieces)
    assert packing.pack(find(no_docs), 64).count() == 0


# -- 1


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over plain dictionaries; a function from an n-gram to its probability."""
    counts = {order: collections.Counter()}
    for t in texts:
        p = "\x02" * (order - 1) + t + "\x03"
        counts[order].update(p[i : i + order] for i in range(len(p) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        of = collections.Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        raw = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k for k in (1, 2, 3)]
        discounts[n] = [min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1)]

    def p(gram):
        found = 1 / (len(counts[1]) + 1)
        for n in range(1, order + 1):
            key = gram[-n:]
            beside = [c for g, c in counts[n].items() if g[:-1] == key[:-1]]
            if beside:
                d, c = discounts[n], counts[n][key]
                held = sum(d[min(x, 3) - 1] for x in beside)
                found = (c - (d[min(c, 3) - 1] if c else 0) + held * found) / sum(beside)
        return found

    return p


def judged_by_hand(spark, rows, trusted, order):
    """Perplexity of each (doc_id, text) of one language: fold by the text's hash, model of the other fold."""
    hashes = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", f"pmod(xxhash64(text), {quality.FOLDS}) f").distinct()
    fold = {r.text: r.f for r in hashes.collect()}
    known = [t for i, t in rows if i in trusted]
    alone = len({fold[t] for t in known}) == 1
    models = [brute_model([t for t in known if alone or fold[t] != f], order) for f in range(quality.FOLDS)]
    out = {}
    for i, t in rows:
        padded = "\x02" * (order - 1) + t + "\x03"
        grams = [padded[k : k + order] for k in range(len(t) + 1)]
        out[i] = math.exp(-sum(math.log(models[fold[t]](g)) for g in grams) / len(grams))
    return out


@pytest.mark.parametrize("order", [3, quality.ORDER])
def test_perplexity_equals_brute_force(spark, order):
    texts = ["abab abba", "aab b", "baa cab", "abc", "cc ab", "ab cab abba", "a b a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, "abz"), (11, "a")]
    docs = spark.createDataFrame([(*r, "en") for r in rows] + [(12, "bb", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(7)] + [(10, 0), (0, 0)], "doc_id long, quality int")
    found = quality.judge(docs, "doc_id", "text", "lang", labels, "doc_id", F.col("quality") == 1, order=order, quantile=0.5)
    want, got = judged_by_hand(spark, rows, range(7), order), {r.doc_id: r for r in found.collect()}
    middle = sorted(want[i] for i in range(7))[3]
    for i, _ in rows:
        assert got[i].perplexity == pytest.approx(want[i], rel=1e-9)
        assert got[i].threshold == pytest.approx(middle, rel=1e-9)
        assert got[i].kept == (got[i].perplexity <= got[i].threshold)
    assert (got[12].perplexity, got[12].threshold, got[12].kept) == (None, None, True)


def test_trusted_texts_of_one_fold_teach_both_models(spark):
    rows = [(0, "abab abba"), (1, "abz"), (2, "cab"), (3, "ba ba"), (4, "abab")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    found = quality.judge(docs, "doc_id", "text", "lang", labels, "doc_id", F.col("quality") == 1, order=3)
    want = judged_by_hand(spark, rows, [0], 3)
    got = {r.doc_id: r for r in found.collect()}
    assert {i: r.perplexity for i, r in got.items()} == pytest.approx(want)
    assert all(r.lang is None and r.threshold == pytest.approx(want[0]) for r in got.values())


def test_a_row_that_repeats_often_is_scored_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 64)
    sizes = []
    scored = quality._scored
    monkeypatch.setattr(quality, "_scored", lambda docs, model: sizes.append(docs.count()) or scored(docs, model))
    rows = [(i, "abab abba"[: 3 + i % 6]) for i in range(20)] + [(None, "bab baba")] * 30 + [(3, "ab ab ab")] * 30
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    found = quality.judge(docs, "doc_id", "text", "lang", labels, "doc_id", F.col("quality") == 1, order=3)
    one = lambda r: (r.doc_id, round(r.perplexity, 9), r.kept)
    got = collections.Counter(one(r) for r in found.collect())
    assert sizes == [22] and sum(got.values()) == 80
    monkeypatch.setattr(quality, "BLOCK_CHARS", 4_000_000)
    plain = quality.judge(docs, "doc_id", "text", "lang", labels, "doc_id", F.col("quality") == 1, order=3)
    assert got == collections.Counter(one(r) for r in plain.collect())


def test_probabilities_of_a_context_sum_to_one():
    p = brute_model(["abab abba", "aab b", "baa"], 3)
    signs = {*"ab \x03"}
    assert sum(p("ab" + c) for c in signs) + p("ab?") == pytest.approx(1, rel=0.02)


def test_quality_of_hard_rows(spark, hard_docs, hard_rows, clashing, no_docs):
    labels = spark.createDataFrame([(8, 1), (12, 1), (12, 0), (None, 1), (500, 1)], "doc_id long, quality int")
    find = lambda df, lab=labels: quality.judge(df, "doc_id", "text", "lang", lab, "doc_id", F.col("quality") == 1)
    found = find(hard_docs)
    rows = found.collect()
    assert len(rows) == len(hard_rows)
    bare = sum(not r[1] for r in hard_rows)
    assert sum(r.perplexity is None and not r.kept for r in rows) == bare
    key = lambda df: sorted(repr((r.doc_id, r.lang, r.kept, round(r.perplexity or 0, 6))) for r in df.collect())
    assert key(find(clashing)) == key(found)
    assert find(no_docs).count() == 0
    assert all(r.kept for r in find(hard_docs, labels.limit(0)).collect() if r.perplexity is None and r.threshold is None) is False
    assert find(hard_docs, labels.limit(0)).where("perplexity is not null").count() == 0

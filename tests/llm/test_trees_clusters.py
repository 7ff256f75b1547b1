"""Merkle manifest and centroid clustering against plain Python versions; toxicity's estimator and accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crease.llm import centroids, merkle, toxicity
from crease.llm.queries import op11_toxicity, op12_merkle, op13_centroids

from .conftest import rows_of

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict, text=None) -> str:
    values = {**row, "text": row["text"] if text is None else text}
    return sha(*("-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS))


def climb(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and each leaf's (before, after) steps."""
    paths, owner, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in owner[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            held.append([i for o in owner[at : at + 8] for i in o])
        nodes, owner = up, held
    return nodes[0], paths


def plain_manifest(rows: list[dict]) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        low = None if r["text"] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        groups[r["lang"]].append((r["doc_id"], leaf_of(r), leaf_of(r, low)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = (leaves, *climb([x[1] for x in leaves]))
    root, above = climb([trees[g][1] for g in order])
    out = Counter()
    for g, over in zip(order, above, strict=True):
        leaves, subroot, paths = trees[g]
        for (i, leaf, seen), path in zip(leaves, paths, strict=True):
            at, path = seen, path + over
            for before, after in path:
                at = sha(before, at, after)
            out[(i, leaf, subroot, root, sha(*(b + a for b, a in path)), at, at == root)] += 1
    return out


def manifest(docs):
    return merkle.manifest(docs, "doc_id", FIELDS, "lang", {"text": merkle.tampered_text()})


def test_manifest_of_hard_rows(hard_docs, hard_rows):
    rows = [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in hard_rows]
    found = manifest(hard_docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in found.collect()) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 600])
def test_manifest_of_uneven_trees(spark, n):
    """Lone leaves, full and ragged levels, many groups; a row repeated often."""
    rnd = random.Random(n)
    rows = [(i, f"Text {i}", "en" if i else None, None, i) for i in range(n)]
    rows += [(1000 + i, "Same" if i % 2 else None, f"l{rnd.randint(0, 20)}", "s", None) for i in range(n // 4)]
    rows += [(5000, "Again", "en", "s", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_manifest([dict(zip(df.columns, r, strict=True)) for r in rows])
    assert Counter(tuple(r) for r in manifest(df).collect()) == want


def test_repeated_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PIECE", 7)
    rows = [(1, "a", "en", "s", 1)] * 50 + [(2, "b", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_manifest([dict(zip(df.columns, r, strict=True)) for r in rows])
    assert Counter(tuple(r) for r in manifest(df).collect()) == want


def test_manifest_of_no_rows_and_clashing_names(no_docs, hard_docs):
    assert manifest(no_docs).collect() == []
    more = hard_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["tree", "digest", "seen", "_n", "lo", "kids", "id", "leaf", "path"])])
    assert rows_of(manifest(more)) == rows_of(manifest(hard_docs))


def test_manifest_plan_is_native_and_unskewed(spark):
    plan = op12_merkle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def plain_clusters(rows, k, rounds, dims, scale):
    def whole(v):
        return [math.floor(Fraction(x) * scale) for x in v]

    kept = [(i, whole(v), v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    marked = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"1:{r[0]}"), r[2]))
    centres = [r[1] for r in marked[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[i]) for x in zip(*own[i], strict=True)] if i in own else c for i, c in enumerate(centres)]
    return [(i, *reversed(near(v))) for i, v, _ in kept], centres


def clusters(df, k=5, rounds=3, dims=4, scale=64):
    found, centres = centroids.cluster(df, "vec_id", "embedding", k, rounds, dims, scale)
    return found, centres


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("size", [0.3, 3.0, 1e6, 1e9])
def test_clusters(spark, size):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [round(x) / 64 for x in np.random.default_rng(i).normal(0, 1, 4)]) for i in range(60)]  # ties
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.25] * 4), (301, None), (302, []), (303, [1.0] * 3), (304, [1.0] * 5)]
    rows += [(305, [1.0, None, 1.0, 1.0]), (306, [1.0, float("nan"), 1.0, 1.0]), (307, [float("inf"), 1.0, 1.0, 1.0]), (308, [0.0] * 4)]
    found, centres = clusters(spark.createDataFrame(rows, VECTORS))
    want, want_centres = plain_clusters(rows, 5, 3, 4, 64)
    assert centres == want_centres
    fits = lambda x: x if x <= centroids.LONG_MAX else None
    got = [(r.vec_id, r.cluster, r.distance) for r in found.collect()]
    assert Counter(got) == Counter((i, c, fits(d)) for i, c, d in want)
    if size < 1e9:
        for r in found.collect():
            assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)


def test_huge_components(spark):
    rows = [(1, [1e300, 0.0, 0.0, 0.0]), (2, [1e300, 1.0, 0.0, 0.0]), (3, [1.0, 2.0, 3.0, 4.0]), (4, [-1e300, 0.1, 0.1, 0.1])]
    found, centres = clusters(spark.createDataFrame(rows, VECTORS), k=2)
    want, want_centres = plain_clusters(rows, 2, 3, 4, 64)
    assert centres == want_centres and {(r.vec_id, r.cluster) for r in found.collect()} == {(i, c) for i, c, _ in want}


def test_few_no_and_equal_vectors(spark):
    for rows in ([], [(1, [0.5] * 4)], [(i, [0.5] * 4) for i in range(40)], [(1, [0.5] * 3)]):
        found, centres = clusters(spark.createDataFrame(rows, VECTORS))
        want, want_centres = plain_clusters(rows, 5, 3, 4, 64)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(want) and centres == want_centres
        assert centroids.with_digest(found, centres).count() == len(want)


def test_clusters_with_clashing_names(spark):
    rows = [(i, [i % 7 / 3, i % 5 / 2, 0.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    more = df.select("*", *[F.lit(1).alias(c) for c in ["_id", "_vec", "cluster", "distance", "inertia", "_mark"]])
    assert rows_of(clusters(more)[0]) == rows_of(clusters(df)[0])


def test_digits_are_exact():
    for x in (0, 1, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 12345678901234567890123, -(10**40)):
        assert sum(d << (32 * i) for i, d in enumerate(centroids.digits(x))) == x


@pytest.mark.parametrize("query", [op12_merkle, op13_centroids])
def test_sql_agrees(spark, query):
    sf = "/root/testdata/sf0.001"
    sql = {op12_merkle: merkle.ORACLE_SQL, op13_centroids: centroids.oracle_sql()}[query]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


def test_risk_and_slopes():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 2, 40), rng.normal(-1, 2, 90)
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    first, second = toxicity.risk(p, u, 0.2)
    assert np.isclose(first, 0.2 * loss(p, 1).mean()) and np.isclose(second, loss(u, -1).mean() - 0.2 * loss(p, -1).mean())
    total = lambda a, b: sum(toxicity.risk(a, b, 0.2))
    sp, su = toxicity.slopes(p, u, 0.2)
    for k in range(3):
        step = np.eye(40)[k] * 1e-5
        assert np.isclose((total(p + step, u) - total(p - step, u)) / 2e-5, sp[k], rtol=1e-4)
        step = np.eye(90)[k] * 1e-5
        assert np.isclose((total(p, u + step) - total(p, u - step)) / 2e-5, su[k], rtol=1e-4)


def test_negative_part_is_undone():
    """Where unlabelled rows cost less than the positives among them, the step raises that part again."""
    p, u = np.full(5, 4.0), np.full(50, -6.0)
    assert toxicity.risk(p, u, 0.5)[1] < 0
    sp, su = toxicity.slopes(p, u, 0.5)
    assert toxicity.risk(p - sp, u - su, 0.5)[1] > toxicity.risk(p, u, 0.5)[1]


def test_features_count_words_and_beginnings():
    found, words = toxicity.tokens("Word WORD words, über x" + " y" * 400)
    assert words == 405
    one, _ = toxicity.tokens("word")
    assert len(one) == 2 and set(one) <= set(found)  # the beginning of four letters and the whole word
    assert len(toxicity.tokens("a" * 30_000)[0]) == 4 and toxicity.tokens("12 !!")[1] == 0
    assert set(toxicity.features("word a b")) < set(toxicity.features("word word a b")) | set(toxicity.features("word a b"))


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ner", "tol", "vim", "sga") for b in ("ero", "unt", "ila") for c in ("s", "men", "ty")]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["grobian", "lumpen", "fiesling"])
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(name="_key"):
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4 != 2


def test_toxic_texts_are_found_and_others_left_alone(marked):
    docs, labels = marked
    model = toxicity.learn(docs, "doc_id", "text", labels, "doc_id", "toxic", fold())
    rows = [r for r in toxicity.scored(docs, "text", ["doc_id"], model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hit = [r.score >= 0.3 for r in rows if r.doc_id % 7 == 0]
    clean = [r.score >= 0.3 for r in rows if r.doc_id % 7]
    assert sum(hit) >= 0.95 * len(hit) and sum(clean) <= 0.01 * len(clean)


def test_labels_of_held_out_rows_are_not_learned(marked):
    docs, labels = marked
    other = labels.withColumn("toxic", F.when(fold("doc_id"), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.learn(docs, "doc_id", "text", x, "doc_id", "toxic", fold()) for x in (labels, other))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_of_hard_rows(spark, hard_docs, no_docs, clashing, marked):
    docs, labels = marked
    model = toxicity.learn(docs, "doc_id", "text", labels, "doc_id", "toxic", fold())
    rows = toxicity.scored(hard_docs, "text", ["doc_id", "text"], model).collect()
    assert len(rows) == hard_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not any(c.isalpha() for c in r.text or "")} == {model.score("")}
    assert toxicity.scored(no_docs, "text", ["doc_id"], model).collect() == []
    assert rows_of(toxicity.scored(clashing, "text", ["doc_id"], model)) == rows_of(toxicity.scored(hard_docs, "text", ["doc_id"], model))
    nothing = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for d, lab in ((hard_docs, nothing), (no_docs, labels), (hard_docs, labels.limit(0))):
        assert toxicity.learn(d, "doc_id", "text", lab, "doc_id", "toxic", fold()) is None
    assert {r.score for r in toxicity.scored(hard_docs, "text", ["doc_id"], None).collect()} == {0.0}


def test_repeated_and_hard_rows_can_be_learned_from(spark, hard_docs, marked):
    """Null ids, repeated ids and a hot row do not disturb the fit."""
    docs, labels = marked
    hot = docs.where("doc_id = 3").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.lit(500)))).select(*docs.columns)
    every = docs.unionByName(hot).unionByName(hard_docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    model = toxicity.learn(every, "doc_id", "text", twice, "doc_id", "toxic", fold())
    rows = toxicity.scored(docs, "text", ["doc_id"], model).collect()
    assert sum((r.score >= 0.3) == (r.doc_id % 7 == 0) for r in rows) >= 0.97 * len(rows)


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    ids = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    df = op11_toxicity(spark, sf)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)

"""Operator 6: nearest neighbours by a hierarchical k-means tree.

The tree is fitted on the driver from a sample of about ``SAMPLE`` vectors; all
vectors are then sorted into its leaves where they lie.  A query walks the tree
best bin first: a priority queue holds the nodes seen so far by their centre's
inner product with the query, and leaves come out in the order in which they
should be searched.

How many leaves to visit is calibrated.  For about ``CALIBRATE`` queries the
true neighbours among all rows are found by brute force, in blocks, and visits
widen until ``target`` of them lie in visited leaves.

Leaves are joined with the queries that visit them.  A task gets some leaves,
about ``GROUP_ROWS`` vectors, and the queries for them in parts of about
``GROUP_QUERIES``; a leaf with more vectors than that is split.  A task returns
the best ``k`` of each query; these are merged at the end.

Scores are summed in double precision component by component, so equal vectors
have equal scores and ties go to the smaller id.

Vectors of each length have a tree of their own; a query's candidates are those of
its length.  Lengths of a few vectors are compared directly, in a task for each.

Defined cases: see ``vectors.usable`` for rows that take no part.  With fewer
than ``k`` candidates a query gets all that it visits.  No queries or no
vectors: no rows.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crease.llm.common import stored
from crease.llm.vectors import by_length, kmeans, matrix, nearest, sample, usable

SAMPLE = 20_000  # vectors that the tree is fitted on
BRANCHES = 16  # children of a node
LEAF_SAMPLE = 256  # sample vectors in a leaf, at most
CALIBRATE = 200  # queries of the calibration
TARGET = 0.97  # share of true neighbours to reach there
GROUP_ROWS = 5_000
GROUP_QUERIES = 10_000
HELD = 300_000  # scored pairs that a task holds before it drops all but the best


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes; node 0 is the root
    children: list[np.ndarray]  # node numbers; empty for leaves

    @staticmethod
    def fit(points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE) -> Tree:
        centres, children = [points.mean(axis=0)], [np.empty(0, dtype=np.int64)]
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            found = kmeans(own, branches)
            if len(found) < 2:
                continue
            children[node] = np.arange(len(centres), len(centres) + len(found))
            part = nearest(own, found)
            for j, centre in enumerate(found):
                centres.append(centre)
                children.append(np.empty(0, dtype=np.int64))
                todo.append((int(children[node][j]), own[part == j]))
        return Tree(np.array(centres), children)

    @property
    def n_leaves(self) -> int:
        return sum(1 for c in self.children if not len(c))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf (node number) of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(self.children[node]):
                out[rows] = node
            elif len(rows):
                part = nearest(points[rows], self.centres[self.children[node]])
                todo += [(int(c), rows[part == j]) for j, c in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves, best bin first."""
        worth = -(self.centres @ query)
        queue, found = [(worth[0], 0)], []
        while queue and len(found) < n:
            _, node = heapq.heappop(queue)
            if len(self.children[node]):
                for c in self.children[node].tolist():
                    heapq.heappush(queue, (worth[c], c))
            else:
                found.append(node)
        return found


def best(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
    """Positions (query, point) and products of each query's ``k`` best points other than itself, as far as they
    reach the query's floor, and all that are within rounding of them."""
    scores = queries @ points.T
    own = np.flatnonzero(np.isin(query_ids, ids))
    scores[own, np.searchsorted(ids, query_ids[own])] = -np.inf  # ids rise
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
    least = np.maximum(least, floor)
    q, p = np.nonzero((scores >= (least - slack(least))[:, None]) & (scores > -np.inf))
    return q, p, scores[q, p]


def slack(score: np.ndarray) -> np.ndarray:
    """More than the rounding of a product near ``score``."""
    return 1e-9 * (1 + np.abs(np.where(np.isfinite(score), score, 0)))


def leading(query: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each query's ``k`` best rows and all within rounding of them; the queries and their k-th scores."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    names, first, inverse, counts = np.unique(q, return_index=True, return_inverse=True, return_counts=True)
    floor = np.where(counts >= k, s[np.minimum(first + k, first + counts) - 1], -np.inf)
    return order[s >= (floor - slack(floor))[inverse]], names, floor


def keep_best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows of each query by score and id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def exact(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed alike for equal vectors."""
    return (queries * points).sum(axis=1)


HITS = [T.StructField("_query", T.LongType()), T.StructField("_vec_id", T.LongType()), T.StructField("_score", T.DoubleType())]
CHUNK = 500  # queries scored at a time


def _true_neighbours(rows: DataFrame, queries: list, tree: Tree, k: int) -> list[tuple[int, int]]:
    """(query number, leaf) of every true neighbour of some queries, from all rows."""
    schema = T.StructType([*HITS, T.StructField("_leaf", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(
        (tree, np.array([r["_id"] for r in queries]), np.array([r["_vec"] for r in queries], dtype=np.float64))
    )

    def run(batches: Iterator[pa.RecordBatch]):
        tree, query_ids, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                ids, points = np.asarray(part.column("_id")), matrix(part.column("_vec"))
                order = np.argsort(ids)
                ids, points = ids[order], points[order]
                q, p, score = best(ids, points, query_ids, vectors, k, np.full(len(vectors), -np.inf))
                score = exact(vectors[q], points[p])
                keep = keep_best(q, ids[p], score, k)
                q, p, score = q[keep], p[keep], score[keep]
                leaf = tree.leaf_of(points)[p]
                columns = [query_ids[q], ids[p], score, leaf]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    first = Window.partitionBy("_query").orderBy(F.desc("_score"), "_vec_id")
    found = rows.mapInArrow(run, schema).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)
    return [(r["_query"], r["_leaf"]) for r in found.select("_query", "_leaf").collect()]


def calibrated_visits(rows: DataFrame, asked: DataFrame, tree: Tree, k: int, target: float) -> int:
    """Least number of leaves that holds ``target`` of the true neighbours of some queries."""
    n = asked.count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("calibrate"), "_id"), 11) / float(1 << 53)
    some = asked.where(chance < CALIBRATE / max(1, n)).limit(2 * CALIBRATE).collect()
    if not some:
        some = asked.limit(CALIBRATE).collect()
    place = {r["_id"]: {leaf: i for i, leaf in enumerate(tree.visits(np.array(r["_vec"]), tree.n_leaves))} for r in some}
    ranks = sorted(place[q][leaf] for q, leaf in _true_neighbours(rows, some, tree, k))
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1 if ranks else 1


RESULT = "query_id long, rank int, vec_id long, score double"


def search(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row with ``is_query`` (of ``_id``)."""
    many, rest = by_length(usable(df, vec_id, vector))
    parts = [search_length(rows, is_query, k, target) for rows in many]
    if rest is not None:
        parts.append(search_few(rest.withColumn("_asked", F.coalesce(is_query, F.lit(False))), k))
    found = parts[0] if parts else df.sparkSession.createDataFrame([], RESULT)
    for x in parts[1:]:
        found = found.unionByName(x)
    return found


def search_few(rows: DataFrame, k: int) -> DataFrame:
    """``search`` of rows whose lengths (``_size``) have few vectors, by comparing all of a length."""

    def run(group: pa.Table) -> pa.Table:
        ids, points = np.asarray(group["_id"]), matrix(group["_vec"])
        q, p = np.nonzero(np.asarray(group["_asked"])[:, None] & (ids[:, None] != ids[None, :]))
        s = exact(points[q], points[p])
        keep = keep_best(q, ids[p], s, k)
        q, p, s = q[keep], p[keep], s[keep]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        return pa.table({"query_id": ids[q], "rank": rank.astype(np.int32), "vec_id": ids[p], "score": s})

    return rows.select("_size", "_id", "_vec", "_asked").groupBy("_size").applyInArrow(run, RESULT)


def search_length(rows: DataFrame, is_query: Column, k: int, target: float) -> DataFrame:
    """``search`` of the queries among rows of one length."""
    n_rows = rows.count()
    asked = rows.where(is_query)
    spark = rows.sparkSession
    points = sample(rows, n_rows, SAMPLE)
    if not len(points):
        points = np.array([r["_vec"] for r in rows.limit(SAMPLE).collect()], dtype=np.float64)
    if not len(points) or asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    tree = Tree.fit(points)
    n_visits = calibrated_visits(rows, asked, tree, k, target)
    shared = spark.sparkContext.broadcast(tree)

    def into_leaves(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            leaf = shared.value.leaf_of(matrix(batch.column("_vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["_id", "_vec", "_leaf"])

    indexed = stored(rows.mapInArrow(into_leaves, "_id long, _vec array<double>, _leaf long"), "ann-leaves")
    groups = max(1, n_rows // GROUP_ROWS)
    parts = max(1, -(-asked.count() // GROUP_QUERIES))
    sizes = indexed.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)).cast("long").alias("_blocks"))
    sizes = stored(sizes, "ann-sizes")  # a row for each leaf of the fitted tree
    blocks = spark.sparkContext.broadcast({r["_leaf"]: r["_blocks"] for r in sizes.collect()})

    def into_visits(batches: Iterator[pa.RecordBatch]):
        """A row for each query and task that it visits, with the leaves to search there."""
        for batch in batches:
            row, group, block, leaves = [], [], [], []
            for i, query in enumerate(matrix(batch.column("_vec"))):
                tasks: dict[tuple[int, int], list[int]] = {}
                for leaf in shared.value.visits(query, n_visits):
                    for b in range(blocks.value.get(leaf, 0)):
                        tasks.setdefault((leaf % groups, b), []).append(leaf)
                for (g, b), own in tasks.items():
                    row.append(i)
                    group.append(g)
                    block.append(b)
                    leaves.append(own)
            at = pa.array(row, pa.int64())
            columns = [batch.column("_id").take(at), batch.column("_vec").take(at)]
            columns += [pa.array(group, pa.int64()), pa.array(block, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_vec", "_group", "_block", "_leaves"])

    visits = "_id long, _vec array<double>, _group long, _block long, _leaves array<long>"
    part = F.pmod(F.xxhash64("_id"), F.lit(parts)).alias("_part")
    right = asked.mapInArrow(into_visits, visits).select("_group", "_block", part, "_id", "_vec", "_leaves")
    left = indexed.join(F.broadcast(sizes), "_leaf").select(
        (F.col("_leaf") % groups).alias("_group"),
        F.pmod(F.xxhash64("_id"), "_blocks").alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"),
        "_leaf",
        "_id",
        "_vec",
    )

    def score(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("_id")
        ids, leaf, points = np.asarray(vectors["_id"]), np.asarray(vectors["_leaf"]), matrix(vectors["_vec"])
        query_ids, queries = np.asarray(asking["_id"]), matrix(asking["_vec"])
        lists = asking["_leaves"].combine_chunks()
        wanted = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(query_ids)), np.diff(np.asarray(lists.offsets)))
        held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        floor, fresh, n_fresh = np.full(len(query_ids), -np.inf), [], 0
        for at in np.intersect1d(leaf, wanted).tolist():
            own, who = np.flatnonzero(leaf == at), owner[wanted == at]
            for a in range(0, len(who), CHUNK):
                some = who[a : a + CHUNK]
                q, p, s = best(ids[own], points[own], query_ids[some], queries[some], k, floor[some])
                fresh.append((some[q], own[p], s))
                n_fresh += len(q)
                if n_fresh > HELD:
                    held = tuple(np.concatenate(c) for c in zip(held, *fresh, strict=True))
                    keep, names, reached = leading(held[0], held[2], k)
                    held, fresh, n_fresh = tuple(c[keep] for c in held), [], 0
                    floor[names] = reached
        q, p, s = (np.concatenate(c) for c in zip(held, *fresh, strict=True))
        keep = leading(q, s, k)[0]
        q, p = q[keep], p[keep]
        s = exact(queries[q], points[p]) if len(q) else s[keep]
        keep = keep_best(q, ids[p], s, k)
        return pa.table({"_query": query_ids[q[keep]], "_vec_id": ids[p[keep]], "_score": s[keep]})

    keys = ["_group", "_block", "_part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, T.StructType(HITS))
    first = Window.partitionBy("_query").orderBy(F.desc("_score"), "_vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("_query").alias("query_id"), "rank", F.col("_vec_id").alias("vec_id"), F.col("_score").alias("score")
    )

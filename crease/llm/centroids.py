"""Operator 13: exact k-means on integer vectors, assigned by a bisector tournament.

Components become integers, ``floor(scale * x)``.  For two centroids i < j a vector
v is nearer to j exactly if ``2 (c_j - c_i) . v - (|c_j|^2 - |c_i|^2) > 0``: the side
of their bisector.  Normals and thresholds of all pairs are computed once for each
round; a vector's champion starts as centroid 0 and meets the others in turn, k - 1
sign tests in all.  Zero is a tie and stays with the champion, which has the smaller
number.  The distance to the last champion is computed exactly.

Spark deals the vectors to tasks, each of which reads them as Arrow batches and
returns its clusters' counts and component sums (k rows); Spark adds these up and
the driver gets k counts and k x dims sums, from which it makes the next centroids.
Sums travel as 32-bit digits, so they are exact whatever their size.  The table is
read once for the seeds and once for each round; nothing is shuffled but the sums.

All arithmetic is exact: 64-bit integers while every component in hand is below
2**27, else Python's integers.

Defined cases.  A vector takes part if it has ``dims`` components, none null or
non-finite; others give no row.  Rows of one id each count and are each returned;
a row without id takes part, but is drawn as seed only after all others; equal
hashes are ordered by components.  With fewer than ``k`` vectors each is a seed.  Of
equal centroids the first gets all their vectors, and a centroid without vectors
stays as it is.  A distance or sum of distances that doesn't fit a long is null.
Empty table: no rows.  Only the named columns are read, so extra columns cannot
clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only, stored

SMALL = 1 << 27  # components below: 64-bit integers hold every sum of dims * 4 products
MOST_DIMS = 64
DIGIT = 32
LONG_MAX = (1 << 63) - 1


def integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the batch that take part, their integer components); the vectors are the last column."""
    vectors = batch.columns[-1]
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.empty((0, dims), dtype=np.int64)
    flat = vectors.take(pa.array(rows)).flatten()
    points = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
    good = np.isfinite(points).all(axis=1)
    rows, points = rows[good], points[good]
    if not len(rows):
        return rows, np.empty((0, dims), dtype=np.int64)
    if np.abs(points).max() * scale < SMALL - 1:
        return rows, np.floor(points * scale).astype(np.int64)
    # whole numbers beyond 2**53 times the scale need no floor
    exact = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in p] for p in points.tolist()]
    return rows, np.array(exact, dtype=object)


class Bisectors:
    """Normals and thresholds of all pairs of centroids, which are of one exact type."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        norms = (centres * centres).sum(axis=1)
        self.k = len(centres)
        self.normals = 2 * (centres[None, :, :] - centres[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def winners(self, points: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each point; the smaller one on ties."""
        champion = np.zeros(len(points), dtype=np.int64)
        for j in range(1, self.k):
            for i in np.unique(champion):  # points of one champion meet the same bisector
                here = np.flatnonzero(champion == i)
                lost = points[here] @ self.normals[i, j] > self.thresholds[i, j]
                champion[here[lost]] = j
        return champion


class Tournament:
    """The centroids' bisectors in 64-bit integers, and in Python's where a batch or the centroids need them."""

    def __init__(self, centres: list[list[int]]):
        self.small = len(centres[0]) <= MOST_DIMS and all(abs(x) < SMALL for c in centres for x in c)
        self.given, self.made = centres, {}

    def play(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points, their winners' numbers, their winners), exactly computed."""
        kind = np.int64 if self.small and points.dtype != object else object
        if kind not in self.made:
            self.made[kind] = Bisectors(np.array(self.given, dtype=kind))
        points = points.astype(kind)
        own = self.made[kind].winners(points)
        return points, own, self.made[kind].centres[own]


def digits(value: int) -> list[int]:
    """``value`` as 32-bit digits, the lowest first; the last one carries the sign."""
    out = []
    while not -(1 << (DIGIT - 1)) <= value < 1 << (DIGIT - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


SUMS = T.StructType([T.StructField(c, T.LongType()) for c in ("cluster", "dim", "digit", "value")])


def update(source: DataFrame, centres: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Centroids after one round: assign every vector, then floor of the mean; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts = [0] * len(centres)
        sums = [[0] * dims for _ in centres]
        tournament = Tournament(centres)
        for batch in batches:
            points, own, _ = tournament.play(integers(batch, dims, scale)[1])
            for i in np.unique(own).tolist():
                mine = points[own == i]
                counts[i] += len(mine)
                sums[i] = [a + int(b) for a, b in zip(sums[i], mine.sum(axis=0), strict=True)]
        rows = [(i, -1, 0, n) for i, n in enumerate(counts) if n]
        rows += [(i, d, at, x) for i, n in enumerate(counts) if n for d in range(dims) for at, x in enumerate(digits(sums[i][d]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)], names=SUMS.names)

    found = source.mapInArrow(run, SUMS).groupBy("cluster", "dim", "digit").agg(F.sum("value").alias("value")).collect()
    counts = {r["cluster"]: r["value"] for r in found if r["dim"] < 0}
    sums = [[0] * dims for _ in centres]
    for r in found:
        if r["dim"] >= 0:
            sums[r["cluster"]][r["dim"]] += r["value"] << (DIGIT * r["digit"])
    return [[s // counts[i] for s in sums[i]] if i in counts else c for i, c in enumerate(centres)]


def seeds(source: DataFrame, k: int, dims: int, scale: int, prefix: str) -> list[list[int]]:
    """The ``k`` vectors of the smallest sha256 of ``prefix`` and their id."""
    value = F.col("_vec")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = source.where((F.size(value) == dims) & ~bad)
    mark = F.sha2(F.concat(F.lit(prefix), F.col("_id").cast("string")), 256)
    drawn = usable.select(mark.alias("_mark"), "_vec").orderBy(F.asc_nulls_last("_mark"), "_vec").limit(k).collect()
    if not drawn:
        return []
    table = pa.record_batch([pa.array([r["_vec"] for r in drawn], pa.list_(pa.float64()))], names=["_vec"])
    return [[int(x) for x in p] for p in integers(table, dims, scale)[1]]


def assigned(source: DataFrame, centres: list[list[int]], dims: int, scale: int) -> DataFrame:
    """(_id, cluster, distance) of every vector that takes part; a distance beyond a long is null."""
    schema = T.StructType([source.schema["_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        tournament = Tournament(centres)
        for batch in batches:
            rows, points = integers(batch, dims, scale)
            points, own, winners = tournament.play(points)
            apart = points - winners
            squares = [x if x <= LONG_MAX else None for x in (apart * apart).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.columns[0].take(pa.array(rows)), pa.array(own.astype(np.int32)), pa.array(squares, pa.int64())], names=schema.names
            )

    return source.mapInArrow(run, schema)


def cluster(
    df: DataFrame, vec_id: str, vector: str, k: int, rounds: int, dims: int, scale: int, prefix: str = "1:"
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, cluster_inertia, inertia) of every vector, and the final centroids."""
    source = only(df, vec_id, vector).toDF("_id", "_vec").withColumn("_vec", F.col("_vec").cast("array<double>"))
    centres = seeds(source, k, dims, scale, prefix)
    for _ in range(rounds if centres else 0):
        centres = update(source, centres, dims, scale)
    # the centroids are final now: without one, nothing takes part
    found = stored(assigned(source, centres or [[0] * dims], dims, scale), "centroid-rows")
    wide = F.col("distance").cast("decimal(38,0)")
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(wide))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows

    def fits(total) -> int | None:
        return None if total is None or total > LONG_MAX else int(total)

    inertia = None if None in sums.values() else fits(sum(sums.values()))
    rows = [(c, fits(s), inertia) for c, s in sums.items()]
    sizes = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(sizes), "cluster").select(F.col("_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia"), centres


def with_digest(found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Adds ``centroid_sha256``: of the final centroid's components in decimal, joined by commas."""
    rows = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)]
    names = found.sparkSession.createDataFrame(rows, "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(*found.columns, "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """DuckDB SQL of the registered query: plain distances to all centroids."""
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, embedding
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS cluster, v AS c FROM kept
  QUALIFY cluster < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
  SELECT r, vec_id, v, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS distance
  FROM kept, c{i})""")
        parts.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT cluster, dim, sum(x) AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS dim FROM a{i}) GROUP BY cluster, dim)""")
            parts.append(f"""c{i + 1} AS (
  SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS m FROM s{i} GROUP BY cluster) USING (cluster))""")
    last = rounds
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)"""

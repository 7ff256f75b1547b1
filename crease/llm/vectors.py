"""Vectors as the search operators read them, and k-means on a sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only, stored, stored_in_turn


FEW_ROWS = 256  # vectors of a length that are compared directly, in one task


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(_id, _vec array<double>): vectors that can be compared.

    Null, empty and zero vectors, those with a null or non-finite component and
    rows without id are left out.  Vectors are compared with those of their own
    length (``by_length``).  For rows of one id the smallest vector stands.
    """
    return usable_at(df, vec_id, vector)[0]


def element(df: DataFrame, vector: str) -> str:
    """The type in which a vector's components are kept on disk: floats as they are, else doubles."""
    kind = df.schema[vector].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def usable_at(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, str]:
    """``usable`` and the folder it is stored in."""
    rows = only(df, vec_id, vector).toDF("_id", "_vec").withColumn("_vec", F.col("_vec").cast(f"array<{element(df, vector)}>"))
    bad = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("_id").isNotNull() & ~bad & F.exists("_vec", lambda x: x != 0)
    best = rows.where(F.coalesce(good, F.lit(False))).groupBy("_id").agg(F.min("_vec").alias("_vec"))
    kept, path = stored_in_turn([best], "vectors")
    return kept.withColumn("_vec", F.col("_vec").cast("array<double>")), path


def by_length(rows: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """The rows of each length that has many vectors, the commonest first and always, and the rows of all other lengths.

    Lengths of at most ``FEW_ROWS`` vectors are left together, as groups that fit one task."""
    counts = stored(rows.groupBy(F.size("_vec").alias("_size")).agg(F.count(F.lit(1)).alias("_rows")), "vector-lengths")
    most = counts.orderBy(F.desc("_rows"), F.desc("_size")).first()
    if most is None:
        return [], None
    many = counts.where((F.col("_rows") > FEW_ROWS) | (F.col("_size") == most["_size"]))
    sizes = [r["_size"] for r in many.orderBy(F.desc("_rows"), F.desc("_size")).collect()]
    rest = rows.withColumn("_size", F.size("_vec")).where(~F.col("_size").isin(sizes))
    return [rows.where(F.size("_vec") == n) for n in sizes], None if rest.isEmpty() else rest


def sample(rows: DataFrame, n_rows: int, size: int) -> np.ndarray:
    """About ``size`` vectors (never more than twice as many), picked by a hash of their id."""
    chance = F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53)
    picked = rows.where(chance < size / max(1, n_rows)).limit(2 * size).select("_id", "_vec").collect()
    return np.array([r["_vec"] for r in sorted(picked, key=lambda r: r["_id"])], dtype=np.float64)


def matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def kmeans(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of at most ``k`` clusters (Lloyd's rounds from evenly spaced points)."""
    centres = np.unique(points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        full = counts > 0
        centres = sums[full] / counts[full, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point."""
    return np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)

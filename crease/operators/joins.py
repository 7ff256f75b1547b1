"""Join helpers with an explicit size check.

Spark's planner broadcasts a side only when its *estimate* is below
``autoBroadcastJoinThreshold``.  Without cost-based statistics, an estimate
taken after a join is the product of the inputs.  So a fixture of a few dozen
matches, derived by joining matches to teams, looks huge and the fact gets
shuffled.  AQE switches to a broadcast only after that shuffle.  Here the key
side is written once and its bytes are summed there (one number to the driver).
It is broadcast when they are within a bound, and otherwise left to the
planner's shuffle join; both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.session import scratch_path

# Largest key set broadcast by ``semi_join_checked``, in bytes of its values.
MAX_BROADCAST_BYTES = 16 << 20
ROW_BYTES = 16  # a row's own cost in the broadcast table


def checked_keys(keys: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``keys`` (distinct, written once), broadcast when its values have at most ``max_bytes`` bytes."""
    spark, path = keys.sparkSession, scratch_path(keys.sparkSession, "join-keys")
    keys.distinct().write.parquet(path)
    stored = spark.read.schema(keys.schema).parquet(path)
    row = F.lit(ROW_BYTES)
    for c in keys.columns:
        row = row + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    size = stored.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).collect()[0]["bytes"]
    return F.broadcast(stored) if size <= max_bytes else stored


def semi_join_checked(big: DataFrame, keys: DataFrame, on: str | list[str], max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``: a broadcast semi join when the key
    set is small (no shuffle of ``big``), a shuffle semi join otherwise."""
    cols = [on] if isinstance(on, str) else list(on)
    return big.join(checked_keys(keys.select(*cols), max_bytes), cols, "left_semi")

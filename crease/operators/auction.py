"""K6: the player auction table, merged on (player_name, season).

The table is partitioned by season.  A merge reads only the seasons that its rows
name, replaces the rows of equal keys and overwrites those partitions alone
(dynamic partition overwrite); other seasons' files stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators.enrich import latest_per_key
from crease.session import scratch_path

# --- fixed values (must equal the reference's) ---
AUCTION_KEYS = ["player_name", "season"]
AUCTION_SCHEMA = "player_name string, season string, team string, sold_price_cr decimal(5,2), base_price_cr decimal(5,2), is_retained boolean"
# --- end fixed values ---
AUCTION_COLUMNS = [c.split()[0] for c in AUCTION_SCHEMA.split(", ")]


def read_auction(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, its columns in schema order; empty where nothing was merged yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], AUCTION_SCHEMA)
    return spark.read.schema(AUCTION_SCHEMA).parquet(path).select(*AUCTION_COLUMNS)


def merge_auction(spark: SparkSession, path: str, rows: DataFrame, order: str) -> list[str]:
    """Insert or update ``rows`` (of one key the last by ``order`` counts); the seasons that were rewritten.

    A key column that is NULL breaks the primary key: nothing is written.  The
    seasons of one merge meet on the driver, rows never do."""
    types = dict(f.split(" ", 1) for f in AUCTION_SCHEMA.split(", "))
    typed = rows.select(*[F.col(c).cast(types[c]).alias(c) for c in AUCTION_COLUMNS], F.col(order).alias("_order"))
    staged = scratch_path(spark, "auction-rows")
    latest_per_key(typed, AUCTION_KEYS, ["_order"]).select(*AUCTION_COLUMNS).write.parquet(staged)
    new = spark.read.schema(AUCTION_SCHEMA).parquet(staged)
    if not new.where("player_name IS NULL OR season IS NULL").isEmpty():
        raise AssertionError("auction rows without player_name or season")
    seasons = sorted(r["season"] for r in new.select("season").distinct().collect())
    if not seasons:
        return []
    old = read_auction(spark, path).where(F.col("season").isin(seasons)).join(new, AUCTION_KEYS, "left_anti")
    merged = scratch_path(spark, "auction-merged")  # whole before the partitions it was read from are replaced
    old.select(*AUCTION_COLUMNS).unionByName(new).write.parquet(merged)
    out = spark.read.schema(AUCTION_SCHEMA).parquet(merged)
    out.hint("rebalance", "season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    return seasons

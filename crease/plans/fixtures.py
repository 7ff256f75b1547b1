"""Adapters materialised once per session (cut lineage with a written table).

The reference loads its star once and then runs every report against the
stored tables.  Queries over adapter A1 do the same: the first use in a
session derives the star from the driver's tables with Spark and writes it
(fact partitioned by season, clustered and sorted; see ``plans.write``) below
the shared checkpoint folder; later queries read it back.  The A3 documents
are stored the same way, as the ingest input.

Nothing is cached in memory or on executor-local disk, so a lost executor
only means re-reading Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import dims
from crease.plans import write
from crease.session import scratch_path
from crease.sources import testdata as td
from crease.sources import typed_documents

_STORED: dict[tuple[str, str, str], str] = {}
_STARS: dict[str, write.StoredStar] = {}


def _exists(spark: SparkSession, root: str) -> bool:
    """The stored table is still there (any filesystem Spark can read)."""
    try:
        spark.read.parquet(root).schema  # noqa: B018 - lists the folder, no job
        return True
    except Exception:  # noqa: BLE001 - missing or unreadable: rebuild
        return False


def _root(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    root = _STORED.get(key)
    if root is None or not _exists(spark, f"{root}/dim_match" if name == "a1" else root):
        root = scratch_path(spark, f"fixture-{name}")
        build(root)
        _STORED[key] = root
    return root


def _spread(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """The matches dealt by id over as many files as their rows ask for, so that reading them is parallel and
    no task holds more as they grow (dealt by key: a round robin sorts the rows of each task first)."""
    return df.repartition(td.tasks_for(spark, sf_dir, "orders"), "match_id")


def _build_a1(spark: SparkSession, sf_dir: str, root: str) -> None:
    dims_out = {
        "dim_player": td.a1_dim_player(spark, sf_dir),
        "dim_team": td.a1_dim_team(spark, sf_dir),
        "dim_venue": td.a1_dim_venue(spark, sf_dir),
        "dim_match": td.a1_dim_match(spark, sf_dir),
    }
    dims_out["dim_match"] = _spread(spark, sf_dir, dims_out["dim_match"])
    write.write_tables(dims_out, root)
    dm = spark.read.parquet(f"{root}/dim_match")
    write.write_table(dims.build_dim_season(dm), f"{root}/dim_season")
    # team names and season come from the stored match table: orders are read once
    teams = spark.read.parquet(f"{root}/dim_team")
    t1 = F.broadcast(teams.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("team1_name")))
    t2 = F.broadcast(teams.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("team2_name")))
    # the line items are shuffled once, by match and as few columns: the sequence window, the join and the write
    # all find a match's rows together, and each task holds a bounded number of them
    tasks = td.tasks_for(spark, sf_dir, "lineitem")
    m = dm.select("match_id", "season_year", "team1_id", "team2_id").repartition(tasks, "match_id")
    m = m.join(t1, "team1_id").join(t2, "team2_id").drop("team1_id", "team2_id")
    fact = td.a1_fact_ball(spark, sf_dir, with_teams=False, tasks=tasks).drop("batting_team", "bowling_team")
    first = F.col("innings_number") == 1
    fact = fact.join(m.hint("merge"), "match_id").select(
        *[
            F.when(first, F.col("team1_name")).otherwise(F.col("team2_name")).alias(c) if c == "batting_team"
            else F.when(first, F.col("team2_name")).otherwise(F.col("team1_name")).alias(c) if c == "bowling_team"
            else F.col(c)
            for c in td.FACT_BALL_COLUMNS
        ],
        "season_year",
    )
    write.write_fact(fact, None, f"{root}/fact_ball", clustered=True)


def a1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 match headers (input of the dimension builders), stored."""
    root = _root(spark, sf_dir, "a1-headers", lambda r: _spread(spark, sf_dir, td.a1_match_headers(spark, sf_dir)).write.parquet(r))
    return spark.read.parquet(root)


def a1_registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 registry entries (lineitem x part x orders), stored."""
    root = _root(spark, sf_dir, "a1-entries", lambda r: td.a1_registry_entries(spark, sf_dir).write.parquet(r))
    return spark.read.parquet(root)


def a1_star(spark: SparkSession, sf_dir: str) -> write.StoredStar:
    """The A1 star as stored tables (fact carries ``season_year`` for pruning)."""
    root = _root(spark, sf_dir, "a1", lambda r: _build_a1(spark, sf_dir, r))
    if root not in _STARS:
        _STARS[root] = write.StoredStar(spark, root)
    return _STARS[root]


def a3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The A3 match documents (path, text) as a stored table."""

    def build(root: str) -> None:
        docs = td.a3_match_documents(spark, sf_dir)
        n = max(1, spark.sparkContext.defaultParallelism)
        docs.repartition(n).write.mode("overwrite").parquet(root)

    return spark.read.parquet(_root(spark, sf_dir, "a3", build))


def a4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The A4 documents (path, text): every kind of wrong-typed field, as a stored table."""

    def build(root: str) -> None:
        tasks = td.tasks_for(spark, sf_dir, "lineitem")
        balls = td.a1_fact_ball(spark, sf_dir, with_teams=False, tasks=tasks)
        docs = typed_documents.a4_documents(td.a1_match_headers(spark, sf_dir), balls, tasks, td.a1_times(spark, sf_dir, tasks))
        docs.write.mode("overwrite").parquet(root)

    return spark.read.parquet(_root(spark, sf_dir, "a4", build))


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Materialise every stored adapter (used by the bench to time it separately)."""
    a1_star(spark, sf_dir)
    a1_headers(spark, sf_dir)
    a1_registry_entries(spark, sf_dir)
    a3_documents(spark, sf_dir).agg(F.count(F.lit(1))).collect()
    a4_documents(spark, sf_dir).agg(F.count(F.lit(1))).collect()

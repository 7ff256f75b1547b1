"""Sinks (K1, K2, K4, K5) and the star's physical layout.

* K1/K2/K4: every table is written as a whole with its columns in schema order; an
  empty input writes an empty table.  A star is written into a folder of its own
  (``versions/<id>``) and published last, by one row appended to the manifest: its
  file appears at once, by the committer's rename.  Readers take the newest row, so
  they see the old star or the new one, never a mixture; a run that dies midway
  leaves a folder that no manifest names.
* K5 (the reference's secondary indexes, re-aimed): the fact is tagged with
  its season and written ``partitionBy(season_year)`` so season filters prune
  directories; rows are rebalanced on (season_year, match_id) so each task writes
  few files, and sorted by (match_id, innings, sequence) so Parquet row-group
  statistics skip data for match filters; Bloom filters of the batter and bowler
  columns let a row group be skipped that holds none of the players asked for.
* Counts and rule violations are observed by the write itself (``observe``), in its
  last stage, so they are those of the rows that were written.
* Nothing is published while a 'fail' row of the quality report is false
  (Parquet enforces no constraint, so the expectations gate the switch).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crease.operators import quality
from crease.schemas import (
    DIM_MATCH_COLUMNS, DIM_PLAYER_COLUMNS, DIM_SEASON_COLUMNS, DIM_TEAM_COLUMNS, DIM_VENUE_COLUMNS, FACT_BALL_COLUMNS,
)

STAR_COLUMNS = {
    "dim_player": DIM_PLAYER_COLUMNS,
    "dim_team": DIM_TEAM_COLUMNS,
    "dim_venue": DIM_VENUE_COLUMNS,
    "dim_season": DIM_SEASON_COLUMNS,
    "dim_match": DIM_MATCH_COLUMNS,
    "fact_ball": FACT_BALL_COLUMNS,
}


def _observed(df: DataFrame, table: str | None) -> tuple[DataFrame, Observation | None]:
    if table is None:
        return df, None
    seen = Observation(f"{table}-{uuid.uuid4().hex[:8]}")
    return df.observe(seen, *quality.observed_metrics(table)), seen


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, table: str | None = None) -> dict[str, int]:
    """K1 + K2: overwrite ``path`` with the columns in the given order; what a write of ``table`` observes."""
    df, seen = _observed(df, table)
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").parquet(path)
    return seen.get if seen else {}


BLOOM_COLUMNS = ("batter_name", "bowler_name", "batter_id", "bowler_id")
ROW_GROUP_MB = 32
BLOOM_VALUES = 20_000  # distinct players a row group is laid out for


def fact_layout(
    fact: DataFrame, dim_match: DataFrame | None, extra_columns: list[str] | None = None, clustered: bool = False, tasks: int | None = None
) -> DataFrame:
    """The fact's rows as ``write_fact`` writes them: tagged with their season, dealt by match, sorted in each task."""
    extra = [c for c in (extra_columns or []) if c in fact.columns and c not in FACT_BALL_COLUMNS and c != "season_year"]
    cols = FACT_BALL_COLUMNS + extra
    if "season_year" in fact.columns:
        tagged = fact.select(*cols, "season_year")
    else:
        tagged, seasons = fact.select(*cols), dim_match.select("match_id", "season_year")
        if tasks is not None:
            tagged, seasons, clustered = tagged.repartition(tasks, "match_id"), seasons.repartition(tasks, "match_id"), True
        tagged = tagged.join(seasons.hint("merge"), "match_id", "left")
    if not clustered:
        tagged = tagged.hint("rebalance", "season_year", "match_id")
    return tagged.sortWithinPartitions("season_year", "match_id", "innings_number", "delivery_sequence")


def write_fact(
    fact: DataFrame, dim_match: DataFrame | None, path: str, extra_columns: list[str] | None = None, table: str | None = None,
    clustered: bool = False, tasks: int | None = None,
) -> dict[str, int]:
    """K4 + K5: the fact, season-partitioned, clustered and sorted for pruning.

    Rows are rebalanced on (season_year, match_id): hash-clustered on those
    keys, with AQE splitting any skewed partition (a hot match) and merging
    small ones; the season is the leading sort key, so each task writes one
    sorted file per season it holds.  Hash (not range) partitioning avoids the
    sampling pass that would compute the whole upstream twice.  The
    season tag comes from ``dim_match`` unless the fact already carries it.
    ``clustered``: the caller has dealt the rows by match over enough tasks, so
    they are sorted and written where they are, without a further shuffle.
    ``tasks``: they are dealt so here, together with the seasons they are tagged with.
    Matches grow with the data, so they are never broadcast.
    """
    rows = fact_layout(fact, dim_match, extra_columns, clustered, tasks)
    rows, seen = _observed(rows, table)
    writer = rows.write.mode("overwrite").partitionBy("season_year").option("parquet.block.size", ROW_GROUP_MB << 20)
    for c in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", BLOOM_VALUES)
    writer.parquet(path)
    return seen.get if seen else {}


def gate(report: DataFrame) -> None:
    """Fail closed on the quality report before any write."""
    if "severity" in report.columns:
        report = report.where(F.col("severity") == "fail")
    quality.assert_passed(report, "pre-write quality gate")


def write_tables(
    tables: dict[str, DataFrame], root: str, observe: bool = False, tasks: int | None = None
) -> tuple[dict[str, str], dict[str, dict]]:
    """Every table below ``root``; the paths, and what the writes observed.  Dimensions come first, and the
    fact is tagged from the written matches.  ``tasks``: see ``write_fact``."""
    paths, seen = {}, {}
    for name in sorted(tables, key=lambda n: n == "fact_ball"):
        df, path, table = tables[name], f"{root.rstrip('/')}/{name}", name if observe else None
        if name == "fact_ball":
            extra = [c for c in df.columns if c not in FACT_BALL_COLUMNS]
            matches = df.sparkSession.read.parquet(paths["dim_match"]) if "dim_match" in paths else None
            seen[name] = write_fact(df, matches, path, extra, table, tasks=tasks)
        else:
            seen[name] = write_table(df, path, [c for c in STAR_COLUMNS.get(name, df.columns) if c in df.columns], table)
        paths[name] = path
    return paths, seen


MANIFEST = "seq bigint, version string, tables array<string>"


def new_version(root: str) -> str:
    """Folder of a star that isn't published yet."""
    return f"{root.rstrip('/')}/versions/{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"


def published(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest published version; None where nothing was published."""
    path = f"{root.rstrip('/')}/manifest"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    newest = spark.read.schema(MANIFEST).json(path).orderBy(F.desc("seq"), F.desc("version")).first()
    return None if newest is None else f"{root.rstrip('/')}/versions/{newest['version']}"


def publish(spark: SparkSession, root: str, folder: str, tables: list[str]) -> None:
    """Switch readers to the star in ``folder``: one row, in one file, is appended to the manifest."""
    path = f"{root.rstrip('/')}/manifest"
    latest = None if published(spark, root) is None else spark.read.schema(MANIFEST).json(path).agg(F.max("seq")).first()[0]
    row = [((latest or 0) + 1, folder.rstrip("/").rsplit("/", 1)[-1], sorted(tables))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(path)


def write_star(tables: dict[str, DataFrame], root: str, report: DataFrame | None = None, tasks: int | None = None) -> dict[str, str]:
    """Write every star table below ``root`` (after the gate) and publish them together; returns the paths."""
    if report is not None:
        gate(report)
    folder = new_version(root)
    paths, _ = write_tables(tables, folder, tasks=tasks)
    publish(next(iter(tables.values())).sparkSession, root, folder, list(tables))
    return paths


class StoredStar:
    """The written star, read back lazily (S8): the version published last when the reader was made.

    A folder without a manifest is read as plain tables."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, (published(spark, root) or root).rstrip("/")
        self._reads: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._reads:
            self._reads[name] = self._spark.read.parquet(f"{self._root}/{name}")
        return self._reads[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("dim_") or name == "fact_ball":
            return self.table(name)
        raise AttributeError(name)

    def register_views(self, names=tuple(STAR_COLUMNS)) -> None:
        """The star's tables as temp views for SQL users."""
        for n in names:
            self.table(n).createOrReplaceTempView(n)


def write_documents(docs: DataFrame, root: str) -> DataFrame:
    """Write each (path, text) document as its own file below ``root``.

    Runs on the executors (``mapInPandas``) through a pyarrow filesystem, so it
    works for local folders and for the shared storage a cluster names; the
    result (one row per file) is small.  Lazy: trigger it with an action.
    """

    def run(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        if root.startswith("file:"):
            fs, base = pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
        elif "://" in root:
            fs, base = pafs.FileSystem.from_uri(root)
        else:
            fs, base = pafs.LocalFileSystem(), root
        base = base.rstrip("/")
        for pdf in batches:
            out_paths, sizes = [], []
            for p, t in zip(pdf["path"], pdf["text"]):
                full = f"{base}/{p.lstrip('/')}"
                fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
                data = (t or "").encode("utf-8")
                with fs.open_output_stream(full) as f:
                    f.write(data)
                out_paths.append(full)
                sizes.append(len(data))
            yield pd.DataFrame({"path": out_paths, "bytes": pd.Series(sizes, dtype="int64")})

    return docs.mapInPandas(run, "path string, bytes long")

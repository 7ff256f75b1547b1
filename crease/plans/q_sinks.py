"""Sink and file-scan keys: the A1 star written and read back, A3 documents written
as files (two folders) and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crease.operators import quality
from crease.oracle.adapters import A1, A2, with_ctes
from crease.plans import write
from crease.plans.catalog import register
from crease.plans.q_ingest import DELIVERY_FLATTEN_BODY, DOCS_SQL, FLATTEN_COLS
from crease.schemas import FACT_BALL_COLUMNS
from crease.session import scratch_path
from crease.sources import documents
from crease.plans import fixtures as fx
from crease.sources import testdata as td


@register("star_roundtrip", with_ctes("SELECT * FROM fact_ball", A1))
def q_star_roundtrip(spark, sf):
    """K1/K2/K4/K5: the A1 star written (behind the quality gate) and read back."""
    s = fx.a1_star(spark, sf)
    tables = {n: s.table(n) for n in ("dim_player", "dim_team", "dim_venue", "dim_match", "dim_season")}
    tables["fact_ball"] = s.fact_ball.drop("season_year")
    report = quality.run_all_checks(tables["fact_ball"], tables, s.dim_player, s.dim_match, {"dim_team": 25, "dim_venue": 5})
    root = scratch_path(spark, "star")
    write.write_star(tables, root, report, td.tasks_for(spark, sf, "lineitem"))
    return write.StoredStar(spark, root).fact_ball.select(*FACT_BALL_COLUMNS)


def _written_documents(spark, sf):
    root = scratch_path(spark, "docs")
    written = write.write_documents(fx.a3_documents(spark, sf), root)
    written.agg(F.count(F.lit(1))).collect()  # runs the distributed write
    return documents.read_documents(spark, root)


FOLDER_SQL = "CASE WHEN match_id % 4 IN (0, 2) THEN 'ipl' ELSE 'other' END"


@register(
    "json_scan",
    with_ctes(f"SELECT CAST(match_id AS VARCHAR) AS match_id, {FOLDER_SQL} AS folder, status FROM verdict", A2, DOCS_SQL),
)
def q_json_scan(spark, sf):
    docs = documents.with_status(_written_documents(spark, sf))
    return docs.select(
        documents.match_id_from_path("path").alias("match_id"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        "status",
    )


@register(
    "file_counts",
    with_ctes(
        f"""SELECT folder, COUNT(*) AS n_files FROM (SELECT {FOLDER_SQL} AS folder FROM docs) GROUP BY folder
UNION ALL SELECT 'TOTAL', COUNT(*) FROM docs""",
        A2,
        DOCS_SQL,
    ),
)
def q_file_counts(spark, sf):
    root = scratch_path(spark, "docs")
    write.write_documents(fx.a3_documents(spark, sf), root).agg(F.count(F.lit(1))).collect()
    return documents.file_counts(documents.list_documents(spark, root))



@register("stream_ingest", with_ctes(DELIVERY_FLATTEN_BODY, A2, DOCS_SQL))
def q_stream_ingest(spark, sf):
    """Incremental ingest: the A3 documents land as files, one availableNow run of the
    stream picks them up, and the appended ball rows are read back."""
    import uuid

    from crease.streaming.ingest import start_ingest

    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "stream-out")
    write.write_documents(fx.a3_documents(spark, sf), landing).agg(F.count(F.lit(1))).collect()
    q = start_ingest(spark, landing, target, name=f"ingest-{uuid.uuid4().hex[:12]}")
    q.awaitTermination()
    return spark.read.parquet(f"{target}/fact_ball").select(*FLATTEN_COLS)


@register("etl_run", with_ctes(DELIVERY_FLATTEN_BODY, A2, DOCS_SQL))
def q_etl_run(spark, sf):
    """The end-to-end job on the A3 documents landed as files: scan, classify, dimensions,
    fact, running columns, constraint gate, write; the written fact is read back."""
    from crease.plans import etl

    src, dst = scratch_path(spark, "etl-src"), scratch_path(spark, "etl-star")
    write.write_documents(fx.a3_documents(spark, sf), src).agg(F.count(F.lit(1))).collect()
    etl.run_etl(spark, src, dst)
    return write.StoredStar(spark, dst).fact_ball.select(*FLATTEN_COLS)

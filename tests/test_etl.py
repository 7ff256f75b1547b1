"""The end-to-end job on a small folder of documents."""

from __future__ import annotations

import json

import pytest
from conftest import delivery, match_doc

from crease.plans import etl, write


def _write_docs(root, docs: dict):
    for rel, d in docs.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(d if isinstance(d, str) else json.dumps(d))


def _good(mid_season="2024", registry=None, pom=None):
    o = [[delivery(runs=(1, 0, 1)), delivery(runs=(4, 0, 4))], [delivery(batter="B", non_striker="A")]]
    extra = {"player_of_match": [pom]} if pom else {}
    return match_doc([("T1", o), ("T2", o)], season=mid_season, registry=registry, city="C", **extra)


def test_etl_writes_star_and_quarantine(spark, tmp_path):
    src, dst = tmp_path / "raw", tmp_path / "star"
    _write_docs(src, {"ipl/1.json": _good(pom="A"), "ipl/2.json": _good("2007/08"), "ipl/bad.json": "{oops", "wpl/3.json": "[]"})
    res = etl.run_etl(spark, str(src), str(dst))
    star = write.StoredStar(spark, str(dst))
    assert star.fact_ball.count() == 12
    assert {r.season_year for r in star.dim_match.collect()} == {2024, 2008}
    assert sorted(r.match_id for r in spark.read.parquet(str(dst / "quarantine")).collect()) == ["3", "bad"]
    assert star.fact_ball.where("cumulative_runs_in_innings IS NULL").count() == 0
    assert len(list(dst.glob("versions/*/fact_ball/season_year=2024"))) == 1
    assert {r.check_name for r in res.checks.where("not passed and severity = 'fail'").collect()} == set()
    counts = {r.check_name: r.observed for r in res.checks.collect()}
    assert counts["row_count:fact_ball"] == 12 and counts["row_count:dim_match"] == 2
    star.register_views()
    assert spark.sql("SELECT count(*) FROM fact_ball JOIN dim_match USING (match_id)").first()[0] == 12
    assert res.report.where("NOT passed").count() == 0


def test_etl_gate_blocks_bad_data(spark, tmp_path):
    src = tmp_path / "raw"
    _write_docs(src, {"1.json": _good("23/24"), "2.json": _good(registry={}, pom="Z")})
    with pytest.raises(AssertionError) as e:
        etl.run_etl(spark, str(src), str(tmp_path / "star"))
    msg = str(e.value)
    assert "season_parse" in msg and "not_null_batter_id" in msg and "unknown_player_of_match" in msg
    assert write.published(spark, str(tmp_path / "star")) is None


def test_enrichment_over_written_star(spark, tmp_path):
    src, dst = tmp_path / "raw", tmp_path / "star"
    _write_docs(src, {"1.json": match_doc([("T1", [[delivery(runs=(2, 0, 2))]])], venue="Eden Gardens")})
    etl.run_etl(spark, str(src), str(dst))
    out = etl.run_enrichment(spark, str(dst), target_dir=str(tmp_path / "enriched"))
    v = out["dim_venue"].first()
    assert (v.capacity, v.avg_first_innings_score) == (68000, 2)


def test_a_failed_run_leaves_the_published_star(spark, tmp_path):
    """The gate refuses the second run: readers keep the first star whole, and the new quarantine is kept."""
    src, dst = tmp_path / "raw", tmp_path / "star"
    _write_docs(src, {"1.json": _good()})
    etl.run_etl(spark, str(src), str(dst))
    _write_docs(src, {"2.json": _good("23/24"), "3.json": "{oops"})
    with pytest.raises(AssertionError, match="season_parse"):
        etl.run_etl(spark, str(src), str(dst))
    star = write.StoredStar(spark, str(dst))
    assert (star.fact_ball.count(), star.dim_match.count()) == (6, 1)
    assert [r.match_id for r in spark.read.parquet(str(dst / "quarantine")).collect()] == ["3"]
    etl.run_etl(spark, str(src), str(dst), strict=False)
    assert write.StoredStar(spark, str(dst)).dim_match.count() == 2 and star.dim_match.count() == 1


def test_a_write_killed_midway_is_never_read(spark, tmp_path):
    """A process that dies between two tables of its second star leaves the first one to readers."""
    import os
    import signal
    import subprocess
    import sys

    code = f"""
import os, signal
from crease.session import build_session
from crease.plans import write
spark = build_session("local[2]", extra={{"spark.sql.shuffle.partitions": "2"}})
teams = lambda n: spark.range(n).selectExpr("cast(id as string) team_id", "'t' team_name", "array('t') team_name_variants")
venues = lambda n: spark.range(n).selectExpr("cast(id as string) venue_id", "'v' venue_name", "'c' city")
root = {str(tmp_path / "star")!r}
write.write_star({{"dim_team": teams(2), "dim_venue": venues(2)}}, root)
whole, done = write.write_table, []
def die(*a, **k):
    if done:
        os.kill(os.getpid(), signal.SIGKILL)
    done.append(1)
    return whole(*a, **k)
write.write_table = die
write.write_star({{"dim_team": teams(5), "dim_venue": venues(5)}}, root)
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, timeout=200)
    assert ran.returncode == -signal.SIGKILL, ran.stderr[-2000:]
    assert len(list((tmp_path / "star" / "versions").iterdir())) == 2
    star = write.StoredStar(spark, str(tmp_path / "star"))
    assert (star.dim_team.count(), star.dim_venue.count()) == (2, 2)


def test_readers_of_a_killed_write_see_the_old_star(spark, tmp_path):
    from pyspark.sql import functions as F

    teams = lambda n: spark.range(n).selectExpr("cast(id as string) team_id", "'t' team_name", "array('t') team_name_variants")
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).alias("venue_id"), F.lit("v").alias("venue_name"), F.lit("c").alias("city"))
    sound = spark.range(2).selectExpr("cast(id as string) venue_id", "'v' venue_name", "'c' city")
    root = str(tmp_path / "star")
    write.write_star({"dim_team": teams(2), "dim_venue": sound}, root)
    with pytest.raises(Exception, match="lost"):
        write.write_star({"dim_team": teams(5), "dim_venue": broken}, root)
    star = write.StoredStar(spark, root)
    assert (star.dim_team.count(), star.dim_venue.count()) == (2, 2)

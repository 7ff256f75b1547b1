"""Plan-shape checks: shuffles, broadcasts, pushdown and pruning are what the design claims."""

from __future__ import annotations

import re

import pytest
from conftest import delivery, docs_frame, match_doc

from crease.operators import derived, dims, flatten
from crease.sources import documents
from crease.sources import testdata as td

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))


@pytest.fixture(scope="module")
def stored_balls(spark, tmp_path_factory):
    rows = [("m", 1, i, 1 + i // 6, i % 6, "A", 1, 1, False) for i in range(300)]
    fact = spark.createDataFrame(
        rows, "match_id string, innings_number int, delivery_sequence int, over_number int, ball_in_over int, "
              "batter_name string, batter_runs int, total_runs int, is_bowler_wicket boolean")
    path = str(tmp_path_factory.mktemp("balls") / "fact")
    fact.write.parquet(path)
    return spark.read.parquet(path)


def test_windows_over_deliveries_never_hold_a_whole_innings(spark, stored_balls):
    plan = plan_of(derived.derived_columns(stored_balls))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[over_number", plan)
    assert len(windows) >= 3 and all("_chunk" in keys for keys in windows)


@pytest.mark.parametrize("adaptive", ["false", "true"])
def test_running_columns_read_and_shuffle_the_fact_once(spark, stored_balls, adaptive):
    """One scan and one shuffle of the balls; the other two shuffles hold a row a chunk (shuffled joins)."""
    conf = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = derived.derived_columns(stored_balls)
        assert df.count() == 300
        df = derived.derived_columns(stored_balls)
        df.collect()
        plan = plan_of(df).split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") == 1 and shuffles(plan) - plan.count("ReusedExchange") == 3


def test_flatten_is_narrow(spark):
    o = [[delivery(), delivery()]]
    accepted, _ = documents.split_documents(docs_frame(spark, {"/m/1.json": match_doc([("T1", o), ("T2", o)])}))
    assert shuffles(plan_of(flatten.build_fact_ball(accepted))) == 0


def test_each_text_of_a_document_is_parsed_once(spark):
    """A filter on the verdict, or a member read twice, must not parse a text again."""
    o = [[delivery(), delivery()]]
    docs = docs_frame(spark, {"/m/1.json": match_doc([("T1", o), ("T2", o)])})
    accepted, quarantine = documents.split_documents(docs)
    levels = {"document": 1, "its root, where it is marked": 1, "innings": 1, "over": 1, "delivery": 1, "wicket": 1, "fielder (name, id)": 2}
    assert plan_of(flatten.build_fact_ball(accepted)).count("from_json(") == sum(levels.values())
    for df in (accepted, quarantine, documents.classify_documents(docs).where("gender_ok AND status = 'ok'")):
        assert plan_of(df).count("from_json(") == 2


def test_the_teams_of_a_match_are_cleaned_once(spark):
    o = [[delivery()]]
    accepted, _ = documents.split_documents(docs_frame(spark, {"/m/1.json": match_doc([("T1", o)])}))
    plan = plan_of(dims.build_dim_match(flatten.match_headers(accepted)))
    assert plan.count("filter(transform(coalesce(") == 1


@pytest.fixture(scope="module")
def star(spark):
    from crease.plans import fixtures

    return fixtures.a1_star(spark, SF)


def test_leaderboard_prunes_columns_and_pushes_filter(spark, star):
    from crease.operators import reports

    plan = plan_of(reports.top_run_scorers(star.fact_ball))
    assert "ReadSchema: struct<batter_name:string,batter_runs:int,is_legal_delivery:boolean>" in plan
    assert "PushedFilters: [IsNotNull(is_legal_delivery), EqualTo(is_legal_delivery,true)]" in plan
    assert "partial_sum" in plan  # map-side combine before the only shuffle
    assert shuffles(plan) == 1


def test_season_reports_prune_fact_partitions(spark, star):
    from crease.operators import reports

    plan = plan_of(reports.squad_batting(star.fact_ball, star.dim_match, star.dim_player, "NATION_0", 1997))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l and "fact_ball" in l]
    assert scan and "PartitionFilters: [isnotnull(season_year" in scan[0] and "(season_year" in scan[0]


def test_grid_pairs_are_broadcast(spark, star):
    from crease.operators import reports, resolve

    names = ["P1", "P2"]
    res = resolve.player_candidates(star.dim_player, names)
    pairs = resolve.grid_pairs(spark, res, names, names)
    plan = plan_of(reports.matchup_grid(star.fact_ball, star.dim_match, pairs, 1990))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_fixture_filter_does_not_shuffle_the_fact(spark, star):
    from crease.operators import reports

    fx = reports.fixture_matches(star.dim_match, star.dim_team, star.dim_venue, "NATION_0", "NATION_1", 1990)
    plan = plan_of(reports.h2h_top_batters(star.fact_ball, fx))
    lines = plan.split("\n")
    scan = next(i for i, l in enumerate(lines) if "FileScan parquet" in l and "fact_ball" in l)
    join = max(i for i in range(scan) if "BroadcastHashJoin" in lines[i])
    assert "LeftSemi" in lines[join]
    assert not any("Exchange" in l for l in lines[join + 1:scan]), lines[join:scan + 1]

"""Plans of jobs over tables that grow: nothing that grows is broadcast, and tasks hold a bounded number of rows."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from crease import session
from crease.operators import derived, enrich, quality
from crease.plans import fixtures, write
from crease.schemas import FACT_BALL_COLUMNS
from crease.sources import testdata as td
from crease.sources import typed_documents

ORDERS = 30


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of the driver's schema; order 1 comes twice, order 2 has no line items."""
    d, day = str(tmp_path_factory.mktemp("sf")), dt.datetime(1996, 5, 1)
    orders = [(k, k % 4, "FOP"[k % 3], 1.0, day + dt.timedelta(days=40 * k), "5-LOW" if k % 2 else "1-URGENT") for k in [*range(ORDERS), 1]]
    lines = [
        (k, 7 * k + n, k + n, n, float(n), 9.5 * n, 0.09 if n == 2 else 0.01, 0.0, "R" if n == 3 else "N", "F", day)
        for k in range(ORDERS) if k != 2 for n in range(1, 6)
    ]
    made = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey bigint, r_name string"),
        "nation": ([(k, f"NATION_{k}", k % 2) for k in range(25)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "customer": ([(k, f"c{k}", k, 0.0, "BUILDING") for k in range(4)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_line_items_are_dealt_once_over_as_many_tasks_as_their_rows_need(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    lines = td.table(spark, tables, "lineitem").count()
    tasks = td.tasks_for(spark, tables, "lineitem")
    fact = td.a1_fact_ball(spark, tables, with_teams=False, tasks=tasks)
    rows = write.fact_layout(fact.withColumn("season_year", F.lit(1996)), None, clustered=True)
    assert tasks >= lines / 10 and rows.rdd.getNumPartitions() == tasks
    assert len(re.findall(r"\bExchange ", plan(rows))) == 1
    below = plan(rows).partition("Exchange ")[2]
    assert "batter_name" not in below and "player_out_name" not in below  # derived after the shuffle


def test_the_star_has_every_line_item_of_every_order(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    star = fixtures.a1_star(spark, tables)
    assert star.dim_match.count() == ORDERS + 1
    assert star.fact_ball.count() == (ORDERS - 1) * 5 + 5  # order 1 comes twice
    want = td.a1_fact_ball(spark, tables)  # teams joined, nothing dealt or stored
    got = star.fact_ball.select(*FACT_BALL_COLUMNS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_customers_and_matches_are_not_broadcast(spark, tables):
    for df in (td.a1_dim_match(spark, tables), td.a1_match_headers(spark, tables)):
        assert "SortMergeJoin [o_custkey" in plan(df)
    fact = td.a1_fact_ball(spark, tables).drop("season_year")
    for tasks in (None, 6):
        rows = write.fact_layout(fact, spark.createDataFrame([(1, 1996)], "match_id bigint, season_year int"), tasks=tasks)
        assert "LeftOuter" in plan(rows) and not re.search(r"Broadcast\w+Join.*LeftOuter", plan(rows))
        assert tasks is None or rows.rdd.getNumPartitions() == tasks


def test_the_venue_average_joins_matches_by_a_shuffle(spark):
    fact = spark.createDataFrame([(1, 1, 4), (1, 1, 2), (1, 2, 9), (2, 1, 3)], "match_id bigint, innings_number int, total_runs int")
    matches = spark.createDataFrame([(1, 7), (2, 7)], "match_id bigint, venue_id bigint")
    out = enrich.first_innings_average(fact, matches)
    assert "Broadcast" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(7, 5)]


def test_documents_are_rendered_without_a_broadcast(spark, tables):
    headers, fact = td.a1_match_headers(spark, tables), td.a1_fact_ball(spark, tables)
    docs = typed_documents.a4_documents(headers, fact, 6)
    assert "SortMergeJoin [key" in plan(docs) and docs.rdd.getNumPartitions() == 6
    plain = typed_documents.a4_documents(headers, fact)
    assert docs.count() == ORDERS + 1 and docs.exceptAll(plain).count() == 0


def test_documents_come_from_the_line_items_without_the_star(spark, tables):
    """Same documents as from the stored star, balls of a repeated order or nation as often as there."""
    headers, star = td.a1_match_headers(spark, tables), fixtures.a1_star(spark, tables)
    want = typed_documents.a4_documents(headers, star.fact_ball)
    balls = td.a1_fact_ball(spark, tables, with_teams=False, tasks=6)
    got = typed_documents.a4_documents(headers, balls, 6, td.a1_times(spark, tables, 6))
    assert got.count() == ORDERS + 1 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r["match_id"]: r["times"] for r in td.a1_times(spark, tables, 6).collect()} == {k: 1 + (k == 1) for k in range(ORDERS)}
    assert len(re.findall(r"Exchange hashpartitioning\(match_id", plan(got))) == 2  # line items and times


def test_running_columns_and_reference_checks_broadcast_nothing(spark, tables):
    fact = td.a1_fact_ball(spark, tables)
    assert "Broadcast" not in plan(derived.derived_columns(spark.createDataFrame(fact.limit(9).collect(), fact.schema)))
    few = spark.createDataFrame([(1, "a"), (2, "b")], "match_id bigint, id string")
    counts = quality.fk_counts(few, {"match_id": (few.where("id = 'a'"), "match_id")})
    assert "LeftAnti" in plan(counts) and not re.search(r"Broadcast\w+Join.*LeftAnti", plan(counts))
    assert [tuple(r) for r in counts.collect()] == [("match_id", 1, 0)]

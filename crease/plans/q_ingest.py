"""Ingest keys over adapter A3 (match documents rendered from the events ball log).

Oracles are computed from the events directly: which documents were truncated
(match_id % 10 = 9), carry an old version (% 10 = 8), another competition
(% 4 = 3) or an unsupported gender (% 7 = 6), and which deliveries carry a
``replacements`` key (k % 13 = 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crease.operators import flatten
from crease.oracle.adapters import A2, with_ctes
from crease.plans.catalog import register
from crease.sources import documents
from crease.plans import fixtures as fx
from crease.sources import testdata as td

EVENTS_SQL = "CASE match_id % 4 " + " ".join(
    f"WHEN {i} THEN '{e.replace(chr(39), chr(39) * 2)}'" for i, e in enumerate(td.A3_EVENTS)
) + " END"

DOCS_SQL = [
    f"""docs AS (
  SELECT DISTINCT match_id FROM ball_log)""",
    f"""verdict AS (
  SELECT match_id,
    CASE WHEN match_id % 10 = {td.A3_TRUNCATE_MOD} THEN 'malformed'
         WHEN match_id % 10 = {td.A3_OLD_VERSION_MOD} THEN 'unsupported_version' ELSE 'ok' END AS status,
    {EVENTS_SQL} AS event_name,
    CASE WHEN match_id % 7 = {td.A3_ODD_GENDER_MOD} THEN 'mixed' WHEN match_id % 4 = 1 THEN 'female' ELSE 'male' END AS gender
  FROM docs)""",
    """kept_docs AS (
  SELECT match_id FROM verdict WHERE status = 'ok' AND match_id % 4 <> 3 AND gender <> 'mixed')""",
    """flat AS (
  SELECT b.*, CAST(row_number() OVER (PARTITION BY b.match_id, b.innings_number ORDER BY b.delivery_sequence) AS INTEGER) AS seq
  FROM ball_log b WHERE b.match_id IN (SELECT match_id FROM kept_docs) AND b.k % 13 <> 0)""",
]


def a3(body: str) -> str:
    return with_ctes(body, A2, DOCS_SQL)


def _classified(spark, sf):
    return documents.classify_documents(fx.a3_documents(spark, sf))


def _fact(spark, sf):
    accepted, _ = documents.split_documents(fx.a3_documents(spark, sf))
    return flatten.build_fact_ball(accepted)


@register(
    "json_quarantine",
    a3(
        """SELECT CAST(match_id AS VARCHAR) AS match_id, status,
  CASE WHEN status <> 'ok' THEN status WHEN match_id % 4 = 3 THEN 'other_competition'
       WHEN gender = 'mixed' THEN 'unsupported_gender' END AS reason
FROM verdict"""
    ),
)
def q_json_quarantine(spark, sf):
    return _classified(spark, sf).select("match_id", "status", "reason")


@register(
    "competition_filter",
    a3(
        """SELECT CAST(match_id AS VARCHAR) AS match_id, event_name, match_id % 4 <> 3 AS competition_ok,
  gender, gender <> 'mixed' AS gender_ok
FROM verdict WHERE status = 'ok'"""
    ),
)
def q_competition_filter(spark, sf):
    return _classified(spark, sf).where(F.col("status") == "ok").select(
        "match_id", "event_name", "competition_ok", "gender", "gender_ok"
    )


FLATTEN_COLS = [
    "match_id", "innings_number", "delivery_sequence", "over_number", "ball_in_over", "batting_team", "bowling_team",
    "batter_name", "batter_id", "bowler_name", "bowler_id", "non_striker_name", "non_striker_id",
    "batter_runs", "extras_runs", "total_runs",
]


DELIVERY_FLATTEN_BODY = """SELECT CAST(match_id AS VARCHAR) AS match_id, innings_number, seq AS delivery_sequence, over_number, ball_in_over,
  CASE WHEN innings_number = 1 THEN 'T1' ELSE 'T2' END AS batting_team,
  CASE WHEN innings_number = 1 THEN 'T2' ELSE 'T1' END AS bowling_team,
  batter_name, 'id-' || batter_name AS batter_id, bowler_name, 'id-' || bowler_name AS bowler_id,
  non_striker_name, 'id-' || non_striker_name AS non_striker_id, batter_runs, extras_runs, total_runs
FROM flat"""


@register("delivery_flatten", a3(DELIVERY_FLATTEN_BODY))
def q_delivery_flatten(spark, sf):
    return _fact(spark, sf).select(*FLATTEN_COLS)


@register(
    "delivery_flags",
    a3(
        """SELECT CAST(match_id AS VARCHAR) AS match_id, innings_number, seq AS delivery_sequence,
  CASE WHEN over_number BETWEEN 1 AND 6 THEN 'powerplay' WHEN over_number BETWEEN 7 AND 15 THEN 'middle' ELSE 'death' END AS match_phase,
  CASE WHEN event_type = 'signup' THEN 'wides' END AS extras_type,
  event_type <> 'signup' AS is_legal_delivery,
  (event_type <> 'signup' AND total_runs = 0 AND NOT is_bowler_wicket) AS is_dot_ball,
  (batter_runs = 4 AND k % 3 <> 0) AS is_boundary_four,
  (batter_runs = 6) AS is_boundary_six,
  is_bowler_wicket AS is_wicket, is_bowler_wicket,
  CASE WHEN is_bowler_wicket THEN 'bowled' END AS wicket_kind,
  CASE WHEN is_bowler_wicket THEN batter_name END AS player_out_name,
  CASE WHEN is_bowler_wicket THEN 'id-' || batter_name END AS player_out_id
FROM flat"""
    ),
)
def q_delivery_flags(spark, sf):
    return _fact(spark, sf).select(
        "match_id", "innings_number", "delivery_sequence", "match_phase", "extras_type", "is_legal_delivery",
        "is_dot_ball", "is_boundary_four", "is_boundary_six", "is_wicket", "is_bowler_wicket", "wicket_kind",
        "player_out_name", "player_out_id",
    )

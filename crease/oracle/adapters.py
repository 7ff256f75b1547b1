"""DuckDB SQL of adapters A1/A2 (mirror of ``crease.sources.testdata``).

Each constant is a list of CTE definitions; ``with_ctes`` prepends the ones a
query needs.  DuckDB never evaluates an unreferenced CTE.
"""

from __future__ import annotations

A1 = [
    """dim_team AS (
  SELECT left(md5(n_name), 8) AS team_id, n_name AS team_name, [n_name] AS team_name_variants FROM nation)""",
    """dim_venue AS (
  SELECT r_regionkey AS venue_id, r_name AS venue_name,
         CASE WHEN r_name <> 'AFRICA' THEN lower(r_name) END AS city FROM region)""",
    """a1_m AS (
  SELECT o.o_orderkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         CAST(c.c_nationkey AS BIGINT) AS team1_key,
         (c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS team2_key
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)""",
    """a1_matches AS (
  SELECT m.o_orderkey AS match_id,
         CAST(year(m.o_orderdate) AS INTEGER) AS season_year,
         CAST(m.o_orderdate AS DATE) AS match_date,
         CASE WHEN m.o_orderpriority = '5-LOW' THEN 'WPL' ELSE 'IPL' END AS tournament,
         CASE WHEN m.o_orderpriority = '5-LOW' THEN 'female' ELSE 'male' END AS gender,
         n1.n_regionkey AS venue_id,
         left(md5(n1.n_name), 8) AS team1_id,
         left(md5(n2.n_name), 8) AS team2_id,
         CAST(NULL AS VARCHAR) AS toss_winner_team_id,
         CAST(NULL AS VARCHAR) AS toss_decision,
         CASE m.o_orderstatus WHEN 'F' THEN left(md5(n1.n_name), 8) WHEN 'O' THEN left(md5(n2.n_name), 8) END AS winner_team_id,
         CAST(CASE WHEN m.o_orderstatus = 'F' THEN 1 + m.o_orderkey % 50 END AS INTEGER) AS win_by_runs,
         CAST(CASE WHEN m.o_orderstatus = 'O' THEN 1 + m.o_orderkey % 10 END AS INTEGER) AS win_by_wickets,
         CASE WHEN m.o_orderstatus = 'P' THEN CASE WHEN m.o_orderkey % 2 = 0 THEN 'tie' ELSE 'no result' END END AS result,
         CAST(NULL AS VARCHAR) AS method,
         CAST(NULL AS VARCHAR) AS player_of_match_id,
         n1.n_name AS team1_name, n2.n_name AS team2_name
  FROM a1_m m JOIN nation n1 ON n1.n_nationkey = m.team1_key JOIN nation n2 ON n2.n_nationkey = m.team2_key)""",
    """dim_match AS (
  SELECT match_id, season_year, match_date, tournament, gender, venue_id, team1_id, team2_id,
         toss_winner_team_id, toss_decision, winner_team_id, win_by_runs, win_by_wickets, result,
         method, player_of_match_id FROM a1_matches)""",
    """a1_f AS (
  SELECT l_orderkey AS match_id,
         CAST(1 + l_linenumber % 2 AS INTEGER) AS innings_number,
         CAST(row_number() OVER (PARTITION BY l_orderkey, 1 + l_linenumber % 2
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS INTEGER) AS delivery_sequence,
         CAST(l_linenumber AS INTEGER) AS over_number,
         1 AS ball_in_over,
         CASE WHEN l_linenumber <= 2 THEN 'powerplay' WHEN l_linenumber <= 5 THEN 'middle' ELSE 'death' END AS match_phase,
         'P' || CAST(l_partkey % 50 AS VARCHAR) AS batter_name,
         l_partkey % 50 AS batter_id,
         'P' || CAST(l_suppkey % 20 AS VARCHAR) AS bowler_name,
         l_suppkey % 20 AS bowler_id,
         'P' || CAST((l_partkey + 1) % 50 AS VARCHAR) AS non_striker_name,
         (l_partkey + 1) % 50 AS non_striker_id,
         CAST(CAST(floor(l_quantity) AS INTEGER) % 7 AS INTEGER) AS batter_runs,
         CAST(CASE WHEN l_returnflag <> 'R' THEN 0 ELSE 1 END AS INTEGER) AS extras_runs,
         CAST(CAST(floor(l_quantity) AS INTEGER) % 7 + CASE WHEN l_returnflag <> 'R' THEN 0 ELSE 1 END AS INTEGER) AS total_runs,
         CASE WHEN NOT (l_returnflag <> 'R') THEN 'wides' END AS extras_type,
         (l_returnflag <> 'R') AS is_legal_delivery,
         ((l_returnflag <> 'R') AND CAST(floor(l_quantity) AS INTEGER) % 7 + CASE WHEN l_returnflag <> 'R' THEN 0 ELSE 1 END = 0
           AND NOT (l_linestatus = 'F' AND l_discount >= 0.08)) AS is_dot_ball,
         (CAST(floor(l_quantity) AS INTEGER) % 7 = 4) AS is_boundary_four,
         (CAST(floor(l_quantity) AS INTEGER) % 7 = 6) AS is_boundary_six,
         (l_linestatus = 'F' AND l_discount >= 0.08) AS is_wicket,
         (l_linestatus = 'F' AND l_discount >= 0.08) AS is_bowler_wicket,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.08 THEN 'bowled' END AS wicket_kind,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.08 THEN
           'P' || CAST(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 50 ELSE l_partkey % 50 + 1 END AS VARCHAR) END AS player_out_name,
         CASE WHEN l_linestatus = 'F' AND l_discount >= 0.08 THEN
           CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 50 ELSE l_partkey % 50 + 1 END END AS player_out_id,
         CAST(NULL AS VARCHAR) AS fielder_name,
         CAST(NULL AS BIGINT) AS fielder_id
  FROM lineitem)""",
    """fact_ball AS (
  SELECT f.match_id, f.innings_number, f.delivery_sequence, f.over_number, f.ball_in_over, f.match_phase,
         CASE WHEN f.innings_number = 1 THEN m.team1_name ELSE m.team2_name END AS batting_team,
         CASE WHEN f.innings_number = 1 THEN m.team2_name ELSE m.team1_name END AS bowling_team,
         f.batter_name, f.batter_id, f.bowler_name, f.bowler_id, f.non_striker_name, f.non_striker_id,
         f.batter_runs, f.extras_runs, f.total_runs, f.extras_type, f.is_legal_delivery, f.is_dot_ball,
         f.is_boundary_four, f.is_boundary_six, f.is_wicket, f.is_bowler_wicket, f.wicket_kind,
         f.player_out_name, f.player_out_id, f.fielder_name, f.fielder_id
  FROM a1_f f JOIN a1_matches m ON f.match_id = m.match_id)""",
    """dim_player AS (
  SELECT player_id, 'P' || CAST(player_id AS VARCHAR) AS player_name,
         ['P' || CAST(player_id AS VARCHAR)] AS name_variants, 'male' AS gender
  FROM (SELECT l_partkey % 50 AS player_id FROM lineitem UNION SELECT l_suppkey % 20 FROM lineitem))""",
]

A2 = [
    """a2_base AS (
  SELECT event_id, ts, event_type, value, user_id // 4 AS match_id,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS innings_number,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)""",
    """a2_seq AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, innings_number ORDER BY ts, event_id) AS seq FROM a2_base)""",
    """ball_log AS (
  SELECT match_id,
         CAST(innings_number AS INTEGER) AS innings_number,
         CAST(seq AS INTEGER) AS delivery_sequence,
         'B' || CAST(k % 11 AS VARCHAR) AS batter_name,
         'W' || CAST(k % 7 AS VARCHAR) AS bowler_name,
         'B' || CAST((k + 1) % 11 AS VARCHAR) AS non_striker_name,
         CAST(CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE CAST(floor(value) AS INTEGER) % 7 END AS INTEGER) AS batter_runs,
         CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INTEGER) AS extras_runs,
         CAST(CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE CAST(floor(value) AS INTEGER) % 7 END
              + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INTEGER) AS total_runs,
         (event_type = 'error' AND k % 5 = 0) AS is_bowler_wicket,
         (event_type <> 'signup') AS is_legal_delivery,
         k, event_type,
         CAST((seq - 1) // 6 + 1 AS INTEGER) AS over_number,
         CAST((seq - 1) % 6 + 1 AS INTEGER) AS ball_in_over
  FROM a2_seq)""",
]


def with_ctes(body: str, *blocks: list[str]) -> str:
    ctes = [c for block in blocks for c in block]
    return "WITH " + ",\n".join(ctes) + "\n" + body

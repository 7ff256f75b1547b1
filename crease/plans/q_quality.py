"""Quality keys over adapter A1 (orphans against nation-key-filtered players)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crease.operators import acceptance, dims, quality
from crease.oracle.adapters import A1, with_ctes
from crease.plans.catalog import register
from crease.plans.q_reports import DIM_SEASON_SQL, cnt
from crease.plans import fixtures as fx
from crease.sources import testdata as td

# fixed sizes of the TPC-H spec tables behind dim_team / dim_venue
EXPECTED_COUNTS = {"dim_team": 25, "dim_venue": 5}
PLAYER_FKS = ["batter_id", "bowler_id", "non_striker_id"]


def _filtered_players(spark, sf):
    """Players whose id is also a nation key: a dimension with known gaps (failing FK case)."""
    n = td.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("player_id"))
    return fx.a1_star(spark, sf).dim_player.join(n, "player_id", "left_semi")


FILTERED_PLAYERS_SQL = "fplayer AS (SELECT * FROM dim_player WHERE player_id IN (SELECT n_nationkey FROM nation))"


def a1(body: str, *extra: str) -> str:
    return with_ctes(body, A1, [DIM_SEASON_SQL, FILTERED_PLAYERS_SQL, *extra])


ROW_COUNT_TABLES = ["dim_player", "dim_team", "dim_venue", "dim_match", "dim_season", "fact_ball"]


def _row_counts_sql() -> str:
    parts = []
    for t in ROW_COUNT_TABLES:
        exp = EXPECTED_COUNTS.get(t)
        exp_sql = f"CAST({exp} AS BIGINT)" if exp is not None else "CAST(NULL AS BIGINT)"
        src = "a1_f" if t == "fact_ball" else t
        parts.append(
            f"SELECT '{t}' AS table_name, COUNT(*) AS actual, {exp_sql} AS expected, "
            f"COALESCE(COUNT(*) = {exp_sql}, TRUE) AS passed FROM {src}"
        )
    return "\nUNION ALL ".join(parts)


def _star_tables(spark, sf):
    s = fx.a1_star(spark, sf)
    return s, {
        "dim_player": s.dim_player, "dim_team": s.dim_team, "dim_venue": s.dim_venue, "dim_match": s.dim_match,
        "dim_season": dims.build_dim_season(s.dim_match), "fact_ball": s.fact_ball,
    }


@register("quality_row_counts", a1(_row_counts_sql()))
def q_quality_row_counts(spark, sf):
    _, tables = _star_tables(spark, sf)
    return quality.row_counts(tables, EXPECTED_COUNTS)


def _orphans_sql(players: str) -> str:
    parts = [
        f"SELECT '{c}' AS fk_column, COUNT(*) AS orphan_rows FROM a1_f f LEFT JOIN {players} p ON f.{c} = p.player_id "
        f"WHERE p.player_id IS NULL"
        for c in PLAYER_FKS
    ]
    parts.append(
        "SELECT 'match_id', COUNT(*) FROM a1_f f LEFT JOIN dim_match m ON f.match_id = m.match_id WHERE m.match_id IS NULL"
    )
    return "\nUNION ALL ".join(parts)


def _orphans(spark, sf, players):
    s = fx.a1_star(spark, sf)
    refs = {c: (players, "player_id") for c in PLAYER_FKS} | {"match_id": (s.dim_match, "match_id")}
    return quality.fk_counts(s.fact_ball, refs).select("fk_column", "orphan_rows")


@register("quality_orphans", a1(_orphans_sql("fplayer")))
def q_quality_orphans(spark, sf):
    return _orphans(spark, sf, _filtered_players(spark, sf))


@register(
    "missing_ids",
    a1(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS fk_column, COUNT(DISTINCT {c}) AS missing_ids, CAST(MIN(CAST({c} AS VARCHAR)) AS VARCHAR) AS sample_id "
            f"FROM a1_f WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT player_id FROM fplayer) HAVING COUNT(*) > 0"
            for c in PLAYER_FKS
        )
    ),
)
def q_missing_ids(spark, sf):
    """Which ids have no dimension row, with a sample."""
    return quality.orphan_ids(fx.a1_star(spark, sf).fact_ball, PLAYER_FKS, _filtered_players(spark, sf), "player_id")


SAMPLED = {
    "batter_id": "batter_name", "bowler_id": "bowler_name", "non_striker_id": "non_striker_name",
    "player_out_id": "player_out_name", "fielder_id": "fielder_name",
}


def _samples_sql() -> str:
    parts = []
    for c, name in SAMPLED.items():
        ids = f"SELECT DISTINCT CAST({c} AS VARCHAR) AS id, {c} NOT IN (SELECT player_id FROM fplayer) AS missing FROM a1_f WHERE {c} IS NOT NULL"
        least = f"(SELECT min(id) FROM ({ids}) WHERE missing)"
        parts.append(f"""SELECT '{c}' AS fk_column, (SELECT COUNT(*) FROM ({ids})) AS unique_ids,
  (SELECT COUNT(*) FROM ({ids}) WHERE missing) AS missing_ids,
  (SELECT COUNT(*) FROM a1_f WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT player_id FROM fplayer)) AS missing_rows,
  (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM ({ids}) WHERE missing ORDER BY id LIMIT 5)) AS sample_ids,
  (SELECT min(CAST(match_id AS VARCHAR) || ',' || {name}) FROM a1_f WHERE CAST({c} AS VARCHAR) = {least}) AS example_row""")
    return "\nUNION ALL ".join(parts)


@register("missing_id_samples", a1(_samples_sql()))
def q_missing_id_samples(spark, sf):
    """J5 over all five id columns: unique and missing ids, rows, the five smallest missing ids, an example row."""
    players = _filtered_players(spark, sf)
    refs = {c: (players, "player_id") for c in SAMPLED}
    return quality.orphan_samples(fx.a1_star(spark, sf).fact_ball, refs, {c: ("match_id", n) for c, n in SAMPLED.items()})


PHASE_SHARE_SQL = """SELECT r.match_phase, COALESCE(c.n, 0) AS n, t.total,
  CAST(COALESCE(c.n, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) AS share, r.min_share, r.max_share,
  (CAST(COALESCE(c.n, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) >= r.min_share
   AND CAST(COALESCE(c.n, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) <= r.max_share) AS in_range
FROM (SELECT * FROM (VALUES ('powerplay', 0.25, 0.40), ('middle', 0.35, 0.55), ('death', 0.15, 0.30)) v(match_phase, min_share, max_share)) r
LEFT JOIN (SELECT match_phase, COUNT(*) AS n FROM a1_f GROUP BY match_phase) c ON c.match_phase = r.match_phase
CROSS JOIN (SELECT COUNT(*) AS total FROM a1_f) t WHERE t.total > 0"""


@register("quality_phase_share", a1(PHASE_SHARE_SQL.replace("r.min_share, r.max_share,", "CAST(r.min_share AS DOUBLE) AS min_share, CAST(r.max_share AS DOUBLE) AS max_share,")))
def q_quality_phase_share(spark, sf):
    return quality.phase_share(fx.a1_star(spark, sf).fact_ball)


DUP_KEYS = ["match_id", "innings_number", "over_number"]


@register(
    "quality_duplicates",
    a1(
        f"""SELECT COUNT(*) AS duplicate_keys, CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS extra_rows
FROM (SELECT {', '.join(DUP_KEYS)}, COUNT(*) AS c FROM a1_f GROUP BY {', '.join(DUP_KEYS)} HAVING COUNT(*) > 1)"""
    ),
)
def q_quality_duplicates(spark, sf):
    return quality.duplicate_keys(fx.a1_star(spark, sf).fact_ball, DUP_KEYS)


@register(
    "quality_report",
    a1(
        f"""SELECT 'row_count:' || table_name AS check_name, 'fail' AS severity, CAST(actual AS DOUBLE) AS observed, passed
FROM ({_row_counts_sql()})
UNION ALL SELECT 'orphans:' || fk_column, 'fail', CAST(orphan_rows AS DOUBLE), orphan_rows = 0 FROM ({_orphans_sql('dim_player')})
UNION ALL SELECT 'phase_share:' || match_phase, 'warn', share, in_range FROM ({PHASE_SHARE_SQL})
UNION ALL SELECT 'duplicates:fact_ball', 'fail', CAST(COUNT(*) AS DOUBLE), COUNT(*) = 0 FROM (
  SELECT match_id, innings_number, delivery_sequence FROM a1_f GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)"""
    ),
)
def q_quality_report(spark, sf):
    s, tables = _star_tables(spark, sf)
    return quality.run_all_checks(s.fact_ball, tables, s.dim_player, s.dim_match, EXPECTED_COUNTS)


def _constraint_sql() -> str:
    rules = quality.fact_ball_rule_sql()
    parts = [f"SELECT 'fact_ball' AS table_name, '{n}' AS constraint_name, {cnt(cond)} AS violations FROM fact_ball" for n, cond in rules]
    columns = {
        "dim_player": "player_id player_name gender", "dim_team": "team_id team_name", "dim_venue": "venue_id venue_name",
        "dim_season": "season_year season_label gender total_matches",
        "dim_match": "match_id season_year tournament gender venue_id team1_id team2_id",
    }
    keys = {"dim_player": "player_id", "dim_team": "team_id", "dim_venue": "venue_id", "dim_season": "season_year, gender", "dim_match": "match_id"}
    for t, names in columns.items():
        src = "fplayer" if t == "dim_player" else t
        parts += [f"SELECT '{t}', 'not_null_{c}', COUNT(*) - COUNT({c}) FROM {src}" for c in names.split()]
        parts.append(f"SELECT '{t}', 'primary_key', (SELECT COUNT(*) FROM {src}) - (SELECT COUNT(*) FROM (SELECT DISTINCT {keys[t]} FROM {src}))")
    for t, src in (("dim_player", "fplayer"), ("dim_season", "dim_season")):
        parts.append(f"SELECT '{t}', 'check_gender', COUNT(*) - COUNT(*) FILTER (WHERE gender = 'male' OR gender = 'female') FROM {src}")
    for c, src, key in (
        ("venue_id", "dim_venue", "venue_id"), ("team1_id", "dim_team", "team_id"), ("team2_id", "dim_team", "team_id"),
        ("toss_winner_team_id", "dim_team", "team_id"), ("winner_team_id", "dim_team", "team_id"), ("player_of_match_id", "fplayer", "player_id"),
    ):
        parts.append(
            f"SELECT 'dim_match', 'fk_{c}', COUNT(*) FROM dim_match m WHERE m.{c} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {src} d WHERE CAST(d.{key} AS VARCHAR) = CAST(m.{c} AS VARCHAR))"
        )
    parts.append(
        "SELECT 'fact_ball', 'primary_key', CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) FROM ("
        "SELECT COUNT(*) AS c FROM a1_f GROUP BY match_id, innings_number, delivery_sequence HAVING COUNT(*) > 1)"
    )
    for c in PLAYER_FKS:
        parts.append(f"SELECT 'fact_ball', 'fk_{c}', COUNT(*) FROM a1_f f LEFT JOIN fplayer p ON f.{c} = p.player_id WHERE p.player_id IS NULL")
    for c in ("player_out_id", "fielder_id"):
        parts.append(
            f"SELECT 'fact_ball', 'fk_{c}', COUNT(*) FROM a1_f f LEFT JOIN fplayer p ON f.{c} = p.player_id "
            f"WHERE p.player_id IS NULL AND f.{c} IS NOT NULL"
        )
    parts.append("SELECT 'fact_ball', 'fk_match_id', COUNT(*) FROM a1_f f WHERE f.match_id NOT IN (SELECT match_id FROM dim_match)")
    return "SELECT *, violations = 0 AS passed FROM (" + "\nUNION ALL ".join(parts) + ")"


@register("constraint_report", a1(_constraint_sql()))
def q_constraint_report(spark, sf):
    s = fx.a1_star(spark, sf)
    return quality.constraint_report(s, _filtered_players(spark, sf))


# Acceptance parameters for the A1 data (the reference's real-data values are the defaults
# of operators.acceptance.AcceptanceParams).
ACCEPT = acceptance.AcceptanceParams(
    year_from=1996, year_to=1998, matches_lo=5000, matches_hi=7000,
    titles_team="NATION_0", titles_min=5, runs_player="P7", runs_min=1000,
    death_leader="P14", wins_teams=("NATION_0", "NATION_1"), team_count=25,
    h2h_a="NATION_0", h2h_b="NATION_1", h2h_lo=30, h2h_hi=40,
)


@register("acceptance_checks", a1(acceptance.acceptance_sql(ACCEPT)))
def q_acceptance_checks(spark, sf):
    s = fx.a1_star(spark, sf)
    return acceptance.acceptance_checks(s.fact_ball, s.dim_match, s.dim_team, ACCEPT)

"""Spark schemas of the match document and the star tables.

The document is polymorphic (event is an object or a string, season an int or a
string, unknown keys under registry and extras), so:
* ``event`` and ``season`` are read as STRING (an object comes back as its JSON text);
* ``innings``, ``overs`` and ``deliveries`` are read as ARRAY<STRING> and every
  element is parsed on its own, because one wrong-typed element would null a
  whole ARRAY<STRUCT> while the reference keeps going;
* wickets and fielders are ARRAY<STRING> for the same reason;
* runs and win margins are read as text and cast afterwards (``4.0`` and ``"4"`` count as 4);
* a field of a wrong type (an array for an object, text for a list) is NULL and its neighbours stay;
* ``non_boundary`` is BOOLEAN, so only a JSON ``true`` vetoes a boundary.
"""

from __future__ import annotations

DOC_SCHEMA = (
    "meta struct<data_version: string>, "
    "info struct<event: string, gender: string, season: string, dates: array<string>, teams: array<string>, "
    "venue: string, city: string, toss: struct<winner: string, decision: string>, "
    "registry: struct<people: map<string, string>>, "
    "outcome: struct<winner: string, by: struct<runs: string, wickets: string>, result: string, method: string>, "
    "player_of_match: array<string>>, "
    "innings array<string>"
)

INNINGS_SCHEMA = "team string, overs array<string>"

OVER_SCHEMA = "over string, deliveries array<string>"

DELIVERY_SCHEMA = (
    "batter string, bowler string, non_striker string, "
    "runs struct<batter: string, extras: string, total: string>, "
    "extras map<string, string>, non_boundary boolean, wickets array<string>"
)

WICKET_SCHEMA = "kind string, player_out string, fielders array<string>"

FIELDER_SCHEMA = "name string"

# --- fixed values (must equal the reference's) ---
# Column order of the star tables (DDL order of the reference's schema).
DIM_PLAYER_COLUMNS = ["player_id", "player_name", "name_variants", "gender"]
DIM_TEAM_COLUMNS = ["team_id", "team_name", "team_name_variants"]
DIM_VENUE_COLUMNS = ["venue_id", "venue_name", "city"]
DIM_SEASON_COLUMNS = ["season_year", "season_label", "gender", "total_matches", "start_date", "end_date"]
DIM_MATCH_COLUMNS = [
    "match_id", "season_year", "match_date", "tournament", "gender", "venue_id", "team1_id", "team2_id",
    "toss_winner_team_id", "toss_decision", "winner_team_id", "win_by_runs", "win_by_wickets", "result",
    "method", "player_of_match_id",
]
FACT_BALL_COLUMNS = [
    "match_id", "innings_number", "delivery_sequence", "over_number", "ball_in_over", "match_phase",
    "batting_team", "bowling_team", "batter_name", "batter_id", "bowler_name", "bowler_id",
    "non_striker_name", "non_striker_id", "batter_runs", "extras_runs", "total_runs", "extras_type",
    "is_legal_delivery", "is_dot_ball", "is_boundary_four", "is_boundary_six", "is_wicket",
    "is_bowler_wicket", "wicket_kind", "player_out_name", "player_out_id", "fielder_name", "fielder_id",
]
# --- end fixed values ---

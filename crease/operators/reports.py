"""Analyst reports over the star (head-to-head, squads, grids, leaderboards).

Every function takes DataFrames plus plain parameters and returns a DataFrame.
Ties the reference leaves unspecified (``LIMIT`` after one sort key) are broken
by name / id so results are deterministic.

Scale notes
* Dimension tables (team, venue, player) are small in this domain; joins to
  them are left to Spark's size-checked broadcast (``autoBroadcastJoinThreshold``
  and AQE's runtime conversion), never forced.
* The fixture filter on ``dim_match`` reduces it to the two teams' meetings
  before the fact join, so the fact side is probed against a tiny build side
  (runtime bloom filter / broadcast) instead of shuffling the whole fact.
* All aggregates are partial-then-final (map-side combine), so a hot key
  (one batter holding a third of the balls) never lands whole in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.numeric import count_if, ratio, round_half_up
from crease.operators.joins import semi_join_checked
from crease.session import scratch_path

# --- fixed values (must equal the reference's) ---
NO_WINNER_RESULTS = ("no result", "tie")
# Sample-size bands of the analysis guide: <12 ignore, 12-24 suggestive,
# 25-60 meaningful, above 60 strong.
SAMPLE_BANDS = ((12, "ignore"), (25, "suggestive"), (61, "meaningful"))
SAMPLE_TOP = "strong"
# Matchup flags: comfort zone SR > 140 with 0 dismissals; bowler dominant SR < 110
# with at least 1 dismissal; pressure when dot% > 50.
COMFORT_SR, DOMINANT_SR, PRESSURE_DOT_PCT = 140.0, 110.0, 50.0
# Squad roles: regular when in >= 60% of the team's season matches, bench below 40%.
REGULAR_SHARE, BENCH_SHARE = 0.60, 0.40
# --- end fixed values ---


# ----------------------------------------------------------------------------
# Fixture (two teams) building block: J2 + J3 + P26 + P27
# ----------------------------------------------------------------------------


def fixture_matches(
    dim_match: DataFrame,
    dim_team: DataFrame,
    dim_venue: DataFrame,
    team_a: str,
    team_b: str,
    since_year: int,
    venue: str | None = None,
    tournament: str = "IPL",
) -> DataFrame:
    """Meetings of two teams (either order) with names, winner and venue attached."""
    pair_teams = dim_team.where(F.col("team_name").isin(team_a, team_b)).select("team_id", "team_name")
    t1 = pair_teams.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("team1"))
    t2 = pair_teams.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("team2"))
    tw = dim_team.select(F.col("team_id").alias("winner_team_id"), F.col("team_name").alias("winner"))
    m = dim_match.where((F.col("tournament") == tournament) & (F.col("season_year") >= since_year))
    m = m.join(t1, "team1_id").join(t2, "team2_id")
    pair = ((F.col("team1") == team_a) & (F.col("team2") == team_b)) | (
        (F.col("team1") == team_b) & (F.col("team2") == team_a)
    )
    m = m.where(pair)
    m = m.join(tw, "winner_team_id", "left").join(dim_venue.select("venue_id", "venue_name", "city"), "venue_id")
    if venue is not None:
        m = m.where(F.col("venue_name") == venue)
    return m


def _wins(team: str) -> Column:
    return count_if(F.col("winner") == team)


def _no_winner() -> Column:
    return count_if(F.col("result").isin(*NO_WINNER_RESULTS) | F.col("winner_team_id").isNull())


def h2h_overall(fixture: DataFrame, team_a: str, team_b: str) -> DataFrame:
    """One row; zeros (not nulls) when the teams never met."""
    return fixture.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.coalesce(_wins(team_a), F.lit(0).cast("bigint")).alias("team_a_wins"),
        F.coalesce(_wins(team_b), F.lit(0).cast("bigint")).alias("team_b_wins"),
        F.coalesce(_no_winner(), F.lit(0).cast("bigint")).alias("no_result_or_tie"),
    )


def h2h_season(fixture: DataFrame, team_a: str, team_b: str) -> DataFrame:
    """R2: per-season meetings and wins."""
    return (
        fixture.groupBy("season_year")
        .agg(F.count(F.lit(1)).alias("matches"), _wins(team_a).alias("team_a_wins"), _wins(team_b).alias("team_b_wins"))
        .orderBy("season_year")
    )


def h2h_venue(fixture: DataFrame, team_a: str, team_b: str, min_matches: int = 2) -> DataFrame:
    """By venue (null cities group together), venues with >= ``min_matches``."""
    return (
        fixture.groupBy("venue_name", "city")
        .agg(F.count(F.lit(1)).alias("matches"), _wins(team_a).alias("team_a_wins"), _wins(team_b).alias("team_b_wins"))
        .where(F.col("matches") >= min_matches)
        .orderBy(F.desc("matches"), F.asc("venue_name"))
    )


def margin_text(runs: Column | str, wickets: Column | str, result: Column | str | None,
                otherwise: str = "n/a") -> Column:
    """P19: 'tie' / 'no result' label, else 'by N runs' / 'by N wickets'; 0 counts as absent.

    The fixed-fixture report's variant ignores the result label and falls back to
    'no result': ``margin_text(runs, wickets, None, otherwise="no result")``.
    """
    r, w = (F.col(x) if isinstance(x, str) else x for x in (runs, wickets))
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    if result is not None:
        res = F.col(result) if isinstance(result, str) else result
        expr = F.when(res.isin(*NO_WINNER_RESULTS), res)
    return (
        expr.when(F.coalesce(r, F.lit(0)) != 0, F.concat(F.lit("by "), r.cast("string"), F.lit(" runs")))
        .when(F.coalesce(w, F.lit(0)) != 0, F.concat(F.lit("by "), w.cast("string"), F.lit(" wickets")))
        .otherwise(F.lit(otherwise))
    )


def h2h_recent(fixture: DataFrame, limit: int = 5) -> DataFrame:
    """Last ``limit`` meetings, newest first (date, then match id)."""
    return (
        fixture.select(
            "match_id", "match_date", "season_year", "team1", "team2", "winner", "win_by_runs",
            "win_by_wickets", "result", "venue_name", "city",
            margin_text("win_by_runs", "win_by_wickets", "result").alias("margin"),
        )
        .orderBy(F.desc("match_date"), F.desc("match_id"))
        .limit(limit)
    )


def _prune_seasons(fact_ball: DataFrame, cond) -> DataFrame:
    """When the fact is stored season-partitioned (``plans.write``), apply the season
    predicate to it directly as well: directory pruning before the match join."""
    return fact_ball.where(cond(F.col("season_year"))) if "season_year" in fact_ball.columns else fact_ball


def _fixture_facts(fact_ball: DataFrame, fixture: DataFrame, since_year: int | None = None) -> DataFrame:
    f = fact_ball if since_year is None else _prune_seasons(fact_ball, lambda s: s >= since_year)
    return semi_join_checked(f, fixture, "match_id")


def h2h_top_batters(fact_ball: DataFrame, fixture: DataFrame, limit: int = 5, since_year: int | None = None) -> DataFrame:
    """Top run scorers in the fixture, by raw name and raw batting team."""
    return (
        _fixture_facts(fact_ball, fixture, since_year)
        .groupBy("batter_name", "batting_team")
        .agg(F.sum("batter_runs").cast("bigint").alias("runs"), F.countDistinct("match_id").alias("matches"))
        .orderBy(F.desc("runs"), F.asc("batter_name"), F.asc("batting_team"))
        .limit(limit)
    )


def h2h_top_bowlers(fact_ball: DataFrame, fixture: DataFrame, limit: int = 5, since_year: int | None = None) -> DataFrame:
    """Top wicket takers in the fixture."""
    return (
        _fixture_facts(fact_ball, fixture, since_year)
        .groupBy("bowler_name", "bowling_team")
        .agg(count_if(F.col("is_bowler_wicket")).alias("wickets"), F.countDistinct("match_id").alias("matches"))
        .orderBy(F.desc("wickets"), F.asc("bowler_name"), F.asc("bowling_team"))
        .limit(limit)
    )


def h2h_semi(dim_match: DataFrame, dim_team: DataFrame, pattern_a: str, pattern_b: str, names: tuple[str, str]) -> DataFrame:
    """Fixed-fixture W/L per season via semi-joins on the team table.

    ``names`` selects both sides' matches; wins are credited through LIKE
    patterns, as the reference does.
    """
    both = dim_team.where(F.col("team_name").isin(*names)).select("team_id")
    side_a = dim_team.where(F.col("team_name").like(pattern_a)).select(F.col("team_id").alias("a_id"))
    side_b = dim_team.where(F.col("team_name").like(pattern_b)).select(F.col("team_id").alias("b_id"))
    m = (
        dim_match.where(F.col("tournament") == "IPL")
        .join(both.withColumnRenamed("team_id", "team1_id"), "team1_id", "left_semi")
        .join(both.withColumnRenamed("team_id", "team2_id"), "team2_id", "left_semi")
    )
    # membership flags via left joins on the tiny side tables (semi-join as a flag)
    m = (
        m.join(side_a.withColumnRenamed("a_id", "team1_id").withColumn("t1_a", F.lit(True)), "team1_id", "left")
        .join(side_a.withColumnRenamed("a_id", "team2_id").withColumn("t2_a", F.lit(True)), "team2_id", "left")
        .join(side_b.withColumnRenamed("b_id", "team1_id").withColumn("t1_b", F.lit(True)), "team1_id", "left")
        .join(side_b.withColumnRenamed("b_id", "team2_id").withColumn("t2_b", F.lit(True)), "team2_id", "left")
    )
    w1 = F.col("winner_team_id") == F.col("team1_id")
    w2 = F.col("winner_team_id") == F.col("team2_id")

    def credited(f1: str, f2: str) -> Column:
        return (F.coalesce(w1, F.lit(False)) & F.col(f1).isNotNull()) | (
            F.coalesce(w2, F.lit(False)) & F.col(f2).isNotNull()
        )

    return (
        m.groupBy("season_year")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            count_if(credited("t1_a", "t2_a")).alias("a_wins"),
            count_if(credited("t1_b", "t2_b")).alias("b_wins"),
        )
        .orderBy("season_year")
    )


def json_document(
    head: dict, sections: list[tuple[str, DataFrame, tuple]], single: tuple[str, ...] = (), names: tuple[str, ...] = (),
) -> DataFrame:
    """K9: one JSON document (one row, column ``doc``) from small result sets.

    ``head`` holds the request parameters (driver-side values).  Each section
    is (name, rows, sort key) with the sort key as (number, number, text, text)
    Columns, ascending; sections named in ``single`` hold one row and become an
    object, those in ``names`` an array of their one column, the others arrays of objects.  Sections are stacked with unions and folded by
    one global aggregate: every section is a bounded report (top-k, one row per
    season / venue / requested pair), so the fold never sees unbounded data.
    """
    blank = F.lit("")
    items = None
    for name, df, (a, b, s1, s2) in sections:
        key = F.struct(
            a.cast("bigint").alias("a"), b.cast("bigint").alias("b"),
            F.coalesce(s1.cast("string"), blank).alias("s1"), F.coalesce(s2.cast("string"), blank).alias("s2"),
        )
        row = F.to_json(F.struct(*[F.col(c) for c in df.columns if c[0] != "_"]), {"ignoreNullFields": "false"})
        if name in names:  # the value alone: what stands in a one-element array
            text = F.to_json(F.array(F.col(df.columns[0])))
            row = F.substring(text, F.lit(2), F.length(text) - 2)
        part = df.select(F.lit(name).alias("section"), key.alias("k"), row.alias("j"))
        items = part if items is None else items.unionByName(part)

    def arr(name: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("k", "j"))))
        return F.concat(F.lit("["), F.array_join(F.transform(picked, lambda x: x["j"]), ","), F.lit("]"))

    def obj(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == name, F.col("j"))), F.lit("{}"))

    pieces = [F.lit(json.dumps(head)[:-1])]
    for i, (name, _, _) in enumerate(sections):
        sep = "," if (head or i) else ""
        pieces += [F.lit(f'{sep}"{name}":'), obj(name) if name in single else arr(name)]
    pieces.append(F.lit("}"))
    return items.agg(F.concat(*pieces).alias("doc"))


def h2h_document(
    overall: DataFrame, per_season: DataFrame, by_venue: DataFrame, recent: DataFrame,
    top_batters: DataFrame, top_bowlers: DataFrame, team_a: str, team_b: str, since_year: int, venue: str | None = None,
) -> DataFrame:
    """The combined head-to-head record as one JSON document (match ids may be text; they don't appear)."""
    zero, blank = F.lit(0), F.lit("")
    return json_document(
        {"team_a": team_a, "team_b": team_b, "since_year": since_year, "venue": venue},
        [
            ("overall", overall, (zero, zero, blank, blank)),
            ("per_season", per_season.withColumnRenamed("season_year", "season"), (F.col("season"), zero, blank, blank)),
            ("by_venue", by_venue.withColumnRenamed("venue_name", "venue"), (-F.col("matches"), zero, F.col("venue"), blank)),
            ("recent_matches", recent.select(
                F.col("match_date").alias("date"), F.col("season_year").alias("season"), "team1", "team2", "winner", "margin",
                F.col("venue_name").alias("venue"), "city", F.col("match_id").cast("string").alias("_id")),
             (-F.unix_date("date"), zero, F.col("_id"), blank)),
            ("top_batters", top_batters.withColumnsRenamed({"batter_name": "name", "batting_team": "team"}),
             (-F.col("runs"), zero, F.col("name"), F.col("team"))),
            ("top_bowlers", top_bowlers.withColumnsRenamed({"bowler_name": "name", "bowling_team": "team"}),
             (-F.col("wickets"), zero, F.col("name"), F.col("team"))),
        ],
        single=("overall",),
    )


def squad_document(batting: DataFrame, bowling: DataFrame, team_name: str, season_year: int, tournament: str = "IPL") -> DataFrame:
    """The squad report (batters and bowlers of a team-season) as one JSON document."""
    zero = F.lit(0)
    return json_document(
        {"team": team_name, "tournament": tournament, "season_year": season_year},
        [
            ("batters", batting, (-F.col("total_runs"), zero, F.col("player_name"), F.lit(""))),
            ("bowlers", bowling, (-F.col("wickets"), -F.col("balls_bowled"), F.col("player_name"), F.lit(""))),
        ],
    )


def matchup_document(grid: DataFrame, requested: DataFrame, since_year: int, phase: str | None = None) -> DataFrame:
    """The batter-versus-bowler grid as one JSON document: an entry for each pair of ``grid``,
    and the names of the ``requested`` pairs without a player."""
    zero, blank = F.lit(0), F.lit("")
    pairs = grid.drop("batter_id", "bowler_id").withColumnsRenamed({"batter_input": "batter", "bowler_input": "bowler"})

    def missing(side: str) -> DataFrame:
        return requested.where(F.col(f"{side}_id").isNull()).select(F.col(f"{side}_input").alias("name")).distinct()

    by_name = (zero, zero, F.col("name"), blank)
    return json_document(
        {"since_year": since_year, "phase": phase},
        [
            ("unresolved_batters", missing("batter"), by_name),
            ("unresolved_bowlers", missing("bowler"), by_name),
            ("matchups", pairs, (zero, zero, F.col("batter"), F.col("bowler"))),
        ],
        names=("unresolved_batters", "unresolved_bowlers"),
    )


# ----------------------------------------------------------------------------
# Squads: R7, R8, P30
# ----------------------------------------------------------------------------


def _season_facts(fact_ball: DataFrame, dim_match: DataFrame, season_year: int, tournament: str) -> DataFrame:
    m = dim_match.where((F.col("season_year") == season_year) & (F.col("tournament") == tournament)).select("match_id")
    return semi_join_checked(_prune_seasons(fact_ball, lambda s: s == season_year), m, "match_id")


def squad_batting(fact_ball: DataFrame, dim_match: DataFrame, dim_player: DataFrame, team_name: str, season_year: int, tournament: str = "IPL") -> DataFrame:
    """Batters for a team-season, grouped by canonical player name (namesakes merge)."""
    f = _season_facts(fact_ball.where(F.col("batting_team") == team_name), dim_match, season_year, tournament)
    p = dim_player.select(F.col("player_id").alias("batter_id"), "player_name")
    return (
        f.join(p, "batter_id")
        .groupBy("player_name")
        .agg(
            F.countDistinct("match_id").alias("matches"),
            F.sum("batter_runs").cast("bigint").alias("total_runs"),
            count_if(F.col("is_legal_delivery")).alias("balls_faced"),
            count_if(F.col("is_boundary_four")).alias("fours"),
            count_if(F.col("is_boundary_six")).alias("sixes"),
        )
        .withColumn("strike_rate", round_half_up(ratio("total_runs", "balls_faced", 100.0), 2))
        .orderBy(F.desc("total_runs"), F.asc("player_name"))
    )


def squad_bowling(fact_ball: DataFrame, dim_match: DataFrame, dim_player: DataFrame, team_name: str, season_year: int, tournament: str = "IPL") -> DataFrame:
    """Bowlers for a team-season; economy uses all runs off the ball (byes included)."""
    f = _season_facts(fact_ball.where(F.col("bowling_team") == team_name), dim_match, season_year, tournament)
    p = dim_player.select(F.col("player_id").alias("bowler_id"), "player_name")
    return (
        f.join(p, "bowler_id")
        .groupBy("player_name")
        .agg(
            F.countDistinct("match_id").alias("matches"),
            count_if(F.col("is_bowler_wicket")).alias("wickets"),
            count_if(F.col("is_legal_delivery")).alias("balls_bowled"),
            F.sum("total_runs").cast("bigint").alias("runs_conceded"),
        )
        .withColumn("economy", round_half_up(ratio("runs_conceded", "balls_bowled", 6.0), 2))
        .orderBy(F.desc("wickets"), F.desc("balls_bowled"), F.asc("player_name"))
    )


def squad_role(fact_ball: DataFrame, dim_match: DataFrame, team_name: str, season_year: int, tournament: str = "IPL") -> DataFrame:
    """Regular (>= 60% of the team's season matches) / bench (< 40%) / rotation.

    A player appears for the team when batting for it or bowling for it.
    """
    m = dim_match.where((F.col("season_year") == season_year) & (F.col("tournament") == tournament)).select("match_id")
    sides = F.array(
        F.when(F.col("batting_team") == team_name, F.col("batter_name")), F.when(F.col("bowling_team") == team_name, F.col("bowler_name"))
    )
    balls = _prune_seasons(fact_ball, lambda s: s == season_year).where((F.col("batting_team") == team_name) | (F.col("bowling_team") == team_name))
    balls = semi_join_checked(balls, m, "match_id")
    # one pass over the fact; what is left is a row for each player and match of a team-season
    appearances = balls.select("match_id", F.explode(F.filter(sides, lambda n: n.isNotNull())).alias("player_name")).distinct()
    path = scratch_path(fact_ball.sparkSession, "appearances")
    appearances.write.parquet(path)
    appearances = fact_ball.sparkSession.read.parquet(path)
    team_matches = appearances.agg(F.countDistinct("match_id").alias("team_matches"))
    per_player = appearances.groupBy("player_name").agg(F.countDistinct("match_id").alias("matches"))
    # one-row total attached by a join on a constant key (one row, broadcast)
    out = per_player.withColumn("_k", F.lit(1)).join(F.broadcast(team_matches.withColumn("_k", F.lit(1))), "_k").drop("_k")
    share = F.col("matches").cast("double") / F.col("team_matches").cast("double")
    return out.select(
        "player_name", "matches", "team_matches",
        round_half_up(share, 4).alias("share"),
        F.when(share >= REGULAR_SHARE, "regular").when(share < BENCH_SHARE, "bench").otherwise("rotation").alias("role"),
    )


# ----------------------------------------------------------------------------
# Batter-versus-bowler grid: R9, J11, P20, P28, P29
# ----------------------------------------------------------------------------


def matchup_grid(
    fact_ball: DataFrame,
    dim_match: DataFrame,
    pairs: DataFrame,
    since_year: int,
    phase: str | None = None,
    tournament: str = "IPL",
) -> DataFrame:
    """One row per requested (batter, bowler) pair, zeros for pairs that never met.

    ``pairs`` holds (batter_input, batter_id, bowler_input, bowler_id), built
    from the user's two name lists by the resolver; its size is the request,
    not the data.  Pairs with an unresolved side are dropped, as the reference
    skips them.
    """
    pairs = pairs.where(F.col("batter_id").isNotNull() & F.col("bowler_id").isNotNull())
    m = dim_match.where((F.col("season_year") >= since_year) & (F.col("tournament") == tournament)).select("match_id")
    f = _prune_seasons(fact_ball, lambda s: s >= since_year)
    if phase is not None:
        f = f.where(F.col("match_phase") == phase)
    # the pairs are applied first, so only the requested pairs' balls reach the match join
    asked = semi_join_checked(f, pairs.select("batter_id", "bowler_id"), ["batter_id", "bowler_id"])
    stats = (
        semi_join_checked(asked, m, "match_id")
        .groupBy("batter_id", "bowler_id")
        .agg(
            count_if(F.col("is_legal_delivery")).alias("balls"),
            F.sum("batter_runs").cast("bigint").alias("runs"),
            count_if(F.col("is_boundary_four")).alias("fours"),
            count_if(F.col("is_boundary_six")).alias("sixes"),
            count_if(F.col("is_dot_ball")).alias("dots"),
            count_if(F.col("is_bowler_wicket") & (F.col("player_out_id") == F.col("batter_id"))).alias("dismissals"),
            F.countDistinct("match_id").alias("matches"),
        )
    )
    g = pairs.join(stats, ["batter_id", "bowler_id"], "left")
    zero = F.lit(0).cast("bigint")
    g = g.select(
        "batter_input", "bowler_input", "batter_id", "bowler_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("matches", "balls", "runs", "fours", "sixes", "dots", "dismissals")],
    )
    return g.withColumn("strike_rate", round_half_up(ratio("runs", "balls", 100.0), 1)).withColumn(
        "dot_pct", round_half_up(ratio("dots", "balls", 100.0), 1)
    )


def matchup_insight(grid: DataFrame) -> DataFrame:
    """P28 + P29: sample-size band and matchup flag per grid row."""
    balls = F.col("balls")
    band = None
    for upper, label in SAMPLE_BANDS:
        band = F.when(balls < upper, label) if band is None else band.when(balls < upper, label)
    band = band.otherwise(SAMPLE_TOP)
    sr, dp, outs = F.col("strike_rate"), F.col("dot_pct"), F.col("dismissals")
    flag = (
        F.when(balls == 0, "first_time")
        .when((sr > COMFORT_SR) & (outs == 0), "comfort_zone")
        .when((sr < DOMINANT_SR) & (outs >= 1), "bowler_dominant")
        .when(dp > PRESSURE_DOT_PCT, "pressure")
        .otherwise("none")
    )
    return grid.select("batter_input", "bowler_input", "balls", "strike_rate", "dot_pct", "dismissals", band.alias("sample_band"), flag.alias("flag"))


# ----------------------------------------------------------------------------
# Leaderboards and summaries: R11-R14, Q14, Q15
# ----------------------------------------------------------------------------


def top_run_scorers(fact_ball: DataFrame, limit: int = 10) -> DataFrame:
    return (
        fact_ball.where(F.col("is_legal_delivery"))
        .groupBy("batter_name")
        .agg(F.sum("batter_runs").cast("bigint").alias("runs"), F.count(F.lit(1)).alias("balls_faced"))
        .orderBy(F.desc("runs"), F.asc("batter_name"))
        .limit(limit)
    )


def top_death_scorers(fact_ball: DataFrame, limit: int = 5, phase: str = "death") -> DataFrame:
    return (
        fact_ball.where((F.col("match_phase") == phase) & F.col("is_legal_delivery"))
        .groupBy("batter_name")
        .agg(F.sum("batter_runs").cast("bigint").alias("runs"))
        .orderBy(F.desc("runs"), F.asc("batter_name"))
        .limit(limit)
    )


def top_wicket_takers(fact_ball: DataFrame, limit: int = 5) -> DataFrame:
    return (
        fact_ball.groupBy("bowler_name")
        .agg(count_if(F.col("is_bowler_wicket")).alias("wickets"))
        .orderBy(F.desc("wickets"), F.asc("bowler_name"))
        .limit(limit)
    )


def season_summary(dim_season: DataFrame, limit: int | None = None) -> DataFrame:
    """Seasons in (year, gender) order; all, or the first ``limit``."""
    out = dim_season.select("season_year", "gender", "season_label", "total_matches", "start_date", "end_date").orderBy(
        "season_year", "gender"
    )
    return out if limit is None else out.limit(limit)


def most_wins(dim_match: DataFrame, dim_team: DataFrame, tournament: str = "IPL") -> DataFrame:
    """Wins per team, most first."""
    t = dim_team.select(F.col("team_id").alias("winner_team_id"), "team_name")
    return (
        dim_match.where(F.col("tournament") == tournament)
        .join(t, "winner_team_id")
        .groupBy("team_name")
        .agg(F.count(F.lit(1)).alias("wins"))
        .orderBy(F.desc("wins"), F.asc("team_name"))
    )


def season_last_win(dim_match: DataFrame, dim_team: DataFrame, team_name: str, tournament: str = "IPL") -> DataFrame:
    """Seasons in which the team won on the date of its own last win of that season.

    The reference's correlated ``IN (SELECT MAX(date) ... WHERE m2.season = m.season)``
    becomes a per-season max and a semi join on (season, date).
    """
    t = dim_team.where(F.col("team_name") == team_name).select(F.col("team_id").alias("winner_team_id"))
    wins = dim_match.where(F.col("tournament") == tournament).join(t, "winner_team_id", "left_semi")
    last = wins.groupBy("season_year").agg(F.max("match_date").alias("match_date"))
    hit = wins.join(last, ["season_year", "match_date"], "left_semi")
    return hit.agg(F.countDistinct("season_year").alias("titles"))


def list_teams(dim_team: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Q15: teams with their short alias (first alias listed for the name)."""
    spark = dim_team.sparkSession
    rows = []
    seen = set()
    for short, full in aliases.items():
        if full not in seen:
            rows.append((full, short))
            seen.add(full)
    alias_df = F.broadcast(spark.createDataFrame(rows, "team_name string, alias string")) if rows else None
    out = dim_team.select("team_name")
    if alias_df is not None:
        out = out.join(alias_df, "team_name", "left")
    else:
        out = out.withColumn("alias", F.lit(None).cast("string"))
    return out.orderBy("team_name")


def team_combo_counts(dim_match: DataFrame, dim_team: DataFrame, pattern_a: str, pattern_b: str, tournament: str = "IPL") -> DataFrame:
    """Q14: meetings per (team1 name, team2 name) combination matching two LIKE patterns."""
    t1 = dim_team.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("team1"))
    t2 = dim_team.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("team2"))
    m = dim_match.where(F.col("tournament") == tournament).join(t1, "team1_id").join(t2, "team2_id")
    either1 = F.col("team1").like(pattern_a) | F.col("team1").like(pattern_b)
    either2 = F.col("team2").like(pattern_a) | F.col("team2").like(pattern_b)
    return (
        m.where(either1 & either2 & (F.col("team1") != F.col("team2")))
        .groupBy("team1", "team2")
        .agg(F.count(F.lit(1)).alias("c"))
        .orderBy(F.desc("c"), "team1", "team2")
    )

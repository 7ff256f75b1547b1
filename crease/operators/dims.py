"""Conformed dimensions built from per-match headers and registry entries.

Inputs (see ``crease.operators.flatten``):
* headers: match_id, order_key, event_name, gender, season, match_date, teams,
  venue, city, toss_winner, toss_decision, winner, win_by_runs, win_by_wickets,
  result, method, player_of_match, registry;
* registry entries: order_key, gender, name, id.

``order_key`` is the "first seen" order (the reference walks files in sorted
path order); picks that depend on it are ``min`` of an (order, value) struct,
a partial aggregate, never a gathered group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.text import blank_to_null, norm, strip, surrogate_key

# --- fixed values (must equal the reference's) ---
# Franchise renames: historical name -> current name.  Separate franchises that
# share a city are deliberately not listed.
TEAM_RENAMES = {
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "Delhi Daredevils": "Delhi Capitals",
    "Kings XI Punjab": "Punjab Kings",
    "Rising Pune Supergiants": "Rising Pune Supergiant",
}
# Split-year labels whose trailing-year rule gives the wrong season.
SEASON_OVERRIDES = {"2020/21": 2020}
# --- end fixed values ---


def canonical_team(name: Column, aliases: dict[str, str] = TEAM_RENAMES) -> Column:
    """Current name of a team (unchanged when not a known rename); a CASE chain,
    evaluated in generated code, no per-row map."""
    expr = None
    for k, v in (aliases or {}).items():
        expr = F.when(name == k, F.lit(v)) if expr is None else expr.when(name == k, F.lit(v))
    return name if expr is None else expr.otherwise(name)


SPLIT_SEASON = r"^([0-9]{2})[0-9]{2}\s*/\s*([0-9]{2})$"


def season_year(label: Column, overrides: dict[str, int] = SEASON_OVERRIDES) -> Column:
    """P5: '2023' -> 2023; '2007/08' -> 2008 (leading century + trailing two digits,
    so '1999/00' -> 1900 as in the reference); overrides first; anything else NULL
    (see ``season_error``)."""
    s = strip(label)
    split = F.regexp_extract(s, SPLIT_SEASON, 0)
    from_split = F.concat(F.regexp_extract(s, SPLIT_SEASON, 1), F.regexp_extract(s, SPLIT_SEASON, 2)).cast("int")
    expr = F.when(s == "", F.lit(None).cast("int"))
    for k, v in overrides.items():
        expr = expr.when(s == k, F.lit(v))
    return (
        expr.when(s.contains("/"), F.when(split != "", from_split))
        .when(s.rlike(r"^[0-9]{4}$"), s.cast("int"))
        .otherwise(F.lit(None).cast("int"))
    )


def season_error(label: Column) -> Column:
    """Why ``season_year`` is NULL: 'empty', 'split', 'format'; NULL when it parsed."""
    s = F.coalesce(strip(label), F.lit(""))
    return (
        F.when(season_year(label).isNotNull(), F.lit(None).cast("string"))
        .when(s == "", "empty")
        .when(s.contains("/"), "split")
        .otherwise("format")
    )


def tournament(event: Column, gender: Column) -> Column:
    """WPL when the event mentions women/wpl or the match is female, else IPL."""
    ev = F.lower(F.coalesce(event, F.lit("")))
    return F.when(ev.contains("women") | ev.contains("wpl") | (gender == "female"), "WPL").otherwise("IPL")


def _clean_teams(teams: Column) -> Column:
    """Stripped, non-blank raw team names."""
    return F.filter(F.transform(F.coalesce(teams, F.array().cast("array<string>")), lambda t: norm(t)), lambda t: t != "")


def build_dim_team(headers: DataFrame, aliases: dict[str, str] = TEAM_RENAMES) -> DataFrame:
    """A10: one row per canonical team; variants = every raw name seen plus the canonical one."""
    raw = headers.select(F.explode(F.coalesce("teams", F.array().cast("array<string>"))).alias("t")).select(norm("t").alias("raw"))
    raw = raw.where(F.col("raw") != "").withColumn("team_name", canonical_team(F.col("raw"), aliases))
    g = raw.groupBy("team_name").agg(F.collect_set("raw").alias("raw_names"))
    return g.select(
        surrogate_key("team_name").alias("team_id"),
        "team_name",
        F.array_sort(F.array_union("raw_names", F.array("team_name"))).alias("team_name_variants"),
    )


def build_dim_venue(headers: DataFrame) -> DataFrame:
    """One row per venue name; city = first non-blank city in file order."""
    v = headers.select(norm("venue").alias("venue_name"), blank_to_null("city").alias("city"), "order_key").where(
        F.col("venue_name") != ""
    )
    g = v.groupBy("venue_name").agg(F.min(F.when(F.col("city").isNotNull(), F.struct("order_key", "city"))).alias("first"))
    return g.select(surrogate_key("venue_name").alias("venue_id"), "venue_name", F.col("first.city").alias("city"))


def build_dim_match(headers: DataFrame, aliases: dict[str, str] = TEAM_RENAMES, keep_errors: bool = False) -> DataFrame:
    """K3 + P15: one row per match with surrogate team / venue keys.

    A season label that does not parse gives NULL ``season_year``; with
    ``keep_errors`` the ``season_error`` column is kept for the quarantine.
    """
    # what several columns or rules read is a column of its own, worked out once
    gender = F.lower(strip(F.coalesce("gender", F.lit(""))))
    names = headers.withColumn("teams", _clean_teams(F.col("teams"))).withColumn("pom", blank_to_null("player_of_match"))
    clubs = {"team1": F.get("teams", F.lit(0)), "team2": F.get("teams", F.lit(1)), "toss": F.col("toss_winner"), "won": F.col("winner")}
    for c, name in clubs.items():
        names = names.withColumn(c, blank_to_null(name))
    for c in clubs:
        names = names.withColumn(c, canonical_team(F.col(c), aliases))
    pom = F.col("pom")
    pom_id = F.when(pom.isNotNull(), F.coalesce(strip(F.element_at(F.col("registry"), pom)), F.lit("")))

    out = names.select(
        strip("match_id").alias("match_id"),
        season_year(F.col("season")).alias("season_year"),
        blank_to_null("match_date").try_cast("date").alias("match_date"),
        tournament(strip("event_name"), gender).alias("tournament"),
        gender.alias("gender"),
        surrogate_key("venue").alias("venue_id"),
        surrogate_key("team1").alias("team1_id"),
        surrogate_key("team2").alias("team2_id"),
        surrogate_key("toss").alias("toss_winner_team_id"),
        blank_to_null("toss_decision").alias("toss_decision"),
        surrogate_key("won").alias("winner_team_id"),
        F.col("win_by_runs").try_cast("double").try_cast("int").alias("win_by_runs"),
        F.col("win_by_wickets").try_cast("double").try_cast("int").alias("win_by_wickets"),
        blank_to_null("result").alias("result"),
        blank_to_null("method").alias("method"),
        pom_id.alias("player_of_match_id"),
        season_error(F.col("season")).alias("season_error"),
    )
    return out if keep_errors else out.drop("season_error")


def build_dim_season(dim_match: DataFrame) -> DataFrame:
    """One row per (season_year, gender): match count, first and last date, label."""
    label = F.concat(F.when(F.col("gender") == "female", "WPL").otherwise("IPL"), F.lit(" "), F.col("season_year").cast("string"))
    return (
        dim_match.groupBy("season_year", "gender")
        .agg(F.count(F.lit(1)).cast("int").alias("total_matches"), F.min("match_date").alias("start_date"), F.max("match_date").alias("end_date"))
        .select("season_year", label.alias("season_label"), "gender", "total_matches", "start_date", "end_date")
    )


def _player_groups(entries: DataFrame) -> DataFrame:
    """Per (id, name): count, and the first (order, gender) with a non-blank gender."""
    g = F.when(F.col("gender") != "", F.struct("order_key", "gender"))
    return entries.groupBy("id", "name").agg(F.count(F.lit(1)).alias("cnt"), F.min(g).alias("first_gender"))


def build_dim_player(entries: DataFrame) -> DataFrame:
    """Canonical name = most frequent, then longest, then smallest; sorted variants;
    gender = first seen in file order ('' when never given)."""
    per_name = _player_groups(entries)
    rank = F.struct((-F.col("cnt")).alias("a"), (-F.length("name")).alias("b"), F.col("name").alias("c"))
    g = per_name.groupBy("id").agg(
        F.min(rank).alias("best"),
        F.array_sort(F.collect_set("name")).alias("name_variants"),
        F.min("first_gender").alias("first_gender"),
    )
    return g.select(
        F.col("id").alias("player_id"),
        F.col("best.c").alias("player_name"),
        "name_variants",
        F.coalesce(F.col("first_gender.gender"), F.lit("")).alias("gender"),
    )


def player_gender_conflicts(entries: DataFrame) -> DataFrame:
    """Players seen with more than one gender, with the genders seen."""
    g = entries.where(F.col("gender") != "").groupBy("id").agg(F.array_sort(F.collect_set("gender")).alias("genders"))
    return g.where(F.size("genders") > 1).select(F.col("id").alias("player_id"), "genders")

"""Name resolution (Q9-Q11) and name-list parsing.

Input names are the user's request (a handful), so they travel as a small
literal DataFrame; the dimension is scanned once.  Resolution picks the best
candidate per input with a partial aggregate (``min`` of a (priority, id)
struct), so no group of candidates is ever gathered in one task.
Ties the reference leaves to "LIMIT 1" go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.text import strip

# --- fixed values (must equal the reference's) ---
# Short team aliases accepted by the head-to-head and squad reports.
TEAM_ALIASES = {
    "RCB": "Royal Challengers Bengaluru",
    "GT": "Gujarat Titans",
    "CSK": "Chennai Super Kings",
    "MI": "Mumbai Indians",
    "KKR": "Kolkata Knight Riders",
    "DC": "Delhi Capitals",
    "PBKS": "Punjab Kings",
    "SRH": "Sunrisers Hyderabad",
    "RR": "Rajasthan Royals",
    "LSG": "Lucknow Super Giants",
    "GL": "Gujarat Lions",
    "RPS": "Rising Pune Supergiant",
}
# --- end fixed values ---


def names_frame(spark: SparkSession, names: list[str], column: str = "input_name") -> DataFrame:
    """The request's names, with their position (first position wins on repeats)."""
    rows = [(i, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, f"pos int, {column} string")


def parse_name_list(text_col: Column) -> Column:
    """Comma list (or one per line) -> array of stripped, non-blank names."""
    parts = F.split(text_col, r"[,\n]")
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def _contains_any(value: Column, inputs: list[str]) -> Column:
    """Array of the inputs ``x`` with ``lower(value) LIKE lower('%x%')`` (wildcards kept)."""
    arr = F.array(*[F.lit(n) for n in inputs]) if inputs else F.array().cast("array<string>")
    return F.filter(arr, lambda n: F.like(F.lower(value), F.lower(F.concat(F.lit("%"), n, F.lit("%")))))


def player_candidates(dim_player: DataFrame, inputs: list[str]) -> DataFrame:
    """Best player per input name in one scan of the dimension.

    Each player row emits (input, priority) for every requested name it matches:
    1 exact name, 2 listed among the name variants, 3 case-insensitive substring
    (LIKE wildcards in the input kept, as in the reference).  The best
    candidate per input is a partial ``min`` of (priority, id, name).
    """
    arr = F.array(*[F.lit(n) for n in dict.fromkeys(inputs)]) if inputs else F.array().cast("array<string>")
    name, variants = F.col("player_name"), F.coalesce(F.col("name_variants"), F.array().cast("array<string>"))

    def prio(n: Column) -> Column:
        like = F.like(F.lower(name), F.lower(F.concat(F.lit("%"), n, F.lit("%"))))
        return F.when(name == n, 1).when(F.array_contains(variants, n), 2).when(like, 3)

    hits = F.filter(F.transform(arr, lambda n: F.struct(n.alias("input_name"), prio(n).alias("prio"))), lambda x: x["prio"].isNotNull())
    cand = dim_player.select("player_id", "player_name", F.explode(hits).alias("h")).select(
        F.col("h.input_name").alias("input_name"), F.struct(F.col("h.prio").alias("prio"), "player_id", "player_name").alias("c")
    )
    return cand.groupBy("input_name").agg(F.min("c").alias("best")).select(
        "input_name",
        F.col("best.player_id").alias("player_id"),
        F.col("best.player_name").alias("player_name"),
        F.col("best.prio").alias("prio"),
    )


def resolve_players(names: DataFrame, dim_player: DataFrame, inputs: list[str]) -> DataFrame:
    """Q10: exact name -> membership in name variants -> case-insensitive substring.

    Returns (pos, input_name, player_id, player_name, match_rule); unresolved
    inputs are kept with null id (Q11).
    """
    best = player_candidates(dim_player, inputs)
    rule = F.when(F.col("prio") == 1, "exact").when(F.col("prio") == 2, "variant").when(F.col("prio") == 3, "substring")
    out = names.join(best, "input_name", "left")
    return out.select("pos", "input_name", "player_id", "player_name", rule.alias("match_rule"))


def resolve_teams(
    names: DataFrame, dim_team: DataFrame, inputs: list[str], aliases: dict[str, str] = TEAM_ALIASES,
    max_candidates: int | None = None,
) -> DataFrame:
    """Q9: alias (case-insensitive) -> exact name -> unique case-insensitive substring.

    Returns (pos, input_name, team_name, candidates, status) with status one of
    alias / exact / substring / ambiguous / none.  ``candidates`` lists the
    substring hits (sorted) for ambiguous inputs: all, or the first ``max_candidates``.
    """
    alias_map = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]) if aliases else None
    alias_hit = F.element_at(alias_map, F.upper(F.col("input_name"))) if alias_map is not None else F.lit(None)
    exact = names.join(dim_team.select(F.col("team_name").alias("input_name")), "input_name", "left_semi").select(
        "input_name", F.col("input_name").alias("exact_name")
    )
    hits = dim_team.select("team_name", F.explode(_contains_any(F.col("team_name"), inputs)).alias("input_name"))
    cands = F.array_sort(F.collect_set("team_name"))  # names of teams: a small dimension
    sub = hits.groupBy("input_name").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.min("team_name").alias("only_hit"),
        (cands if max_candidates is None else F.slice(cands, 1, max_candidates)).alias("cands"),
    )
    out = names.withColumn("alias_name", alias_hit).join(exact, "input_name", "left").join(sub, "input_name", "left")
    status = (
        F.when(F.col("alias_name").isNotNull(), "alias")
        .when(F.col("exact_name").isNotNull(), "exact")
        .when(F.col("n_hits") == 1, "substring")
        .when(F.col("n_hits") > 1, "ambiguous")
        .otherwise("none")
    )
    team = F.coalesce(F.col("alias_name"), F.col("exact_name"), F.when(F.col("n_hits") == 1, F.col("only_hit")))
    cands = F.when(status == "ambiguous", F.col("cands"))
    return out.select("pos", "input_name", team.alias("team_name"), cands.alias("candidates"), status.alias("status"))


def grid_pairs(spark: SparkSession, resolved: DataFrame, batter_names: list[str], bowler_names: list[str]) -> DataFrame:
    """The requested (batter, bowler) pairs with resolved ids.

    The pair list is the product of the two request lists (built on the driver
    from parameters, not from data); ``resolved`` is ``player_candidates`` over
    both lists at once, joined to each side.
    """
    pairs = spark.createDataFrame(
        [(b, w) for b in dict.fromkeys(batter_names) for w in dict.fromkeys(bowler_names)],
        "batter_input string, bowler_input string",
    )
    bat = resolved.select(F.col("input_name").alias("batter_input"), F.col("player_id").alias("batter_id"))
    bowl = resolved.select(F.col("input_name").alias("bowler_input"), F.col("player_id").alias("bowler_id"))
    return pairs.join(bat, "batter_input", "left").join(bowl, "bowler_input", "left")

"""Adapters A1-A3: project the driver's synthetic tables onto the match data model.

They are inputs, not operators (FIXTURES.md section 3).  Each is written once here
with the DataFrame API and once in DuckDB SQL (``crease.oracle.adapters``); the
two must stay expression-for-expression equal.

* A1 ``star``: orders/customer/nation/region/lineitem -> dim_team, dim_venue,
  dim_match, dim_player, fact_ball.
* A2 ``ball_log``: events -> a ball-by-ball log for the running-window columns.
* A3 ``match_documents``: A2 rendered as one nested JSON text per match, the
  reference's input format, for the ingest operators.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.schemas import DIM_MATCH_COLUMNS, FACT_BALL_COLUMNS
from crease.session import tasks_for_rows


_READS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver's data set; the (lazy) reader is reused per session
    so repeated references do not list files and read footers again."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READS[key] = df
    return df


def tasks_for(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for the rows of a table (counted from its file footers)."""
    return tasks_for_rows(spark, table(spark, sf_dir, name).count())


def _hex8(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


# ----------------------------------------------------------------------------
# A1: match star
# ----------------------------------------------------------------------------


def a1_dim_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        _hex8(F.col("n_name")).alias("team_id"),
        F.col("n_name").alias("team_name"),
        F.array(F.col("n_name")).alias("team_name_variants"),
    )


def a1_dim_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(
        F.col("r_regionkey").alias("venue_id"),
        F.col("r_name").alias("venue_name"),
        F.when(F.col("r_name") != "AFRICA", F.lower("r_name")).alias("city"),
    )


def _a1_teams(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    # TPC-H nation has exactly 25 rows by specification: a proven size bound.
    n = table(spark, sf_dir, "nation")
    return F.broadcast(
        n.select(
            F.col("n_nationkey").alias(f"{side}_key"),
            _hex8(F.col("n_name")).alias(f"{side}_id"),
            F.col("n_name").alias(f"{side}_name"),
            F.col("n_regionkey").alias(f"{side}_region"),
        )
    )


def a1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_match columns plus the two raw team names (for fact_ball)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # customers grow with the data; the planner would broadcast them by the size of their (packed) files
    m = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderdate",
        "o_orderpriority",
        F.col("c_nationkey").cast("bigint").alias("team1_key"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).alias("team2_key"),
    )
    m = m.join(_a1_teams(spark, sf_dir, "team1"), "team1_key").join(
        _a1_teams(spark, sf_dir, "team2"), "team2_key"
    )
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    wpl = F.col("o_orderpriority") == "5-LOW"
    return m.select(
        key.alias("match_id"),
        F.year("o_orderdate").alias("season_year"),
        F.to_date("o_orderdate").alias("match_date"),
        F.when(wpl, "WPL").otherwise("IPL").alias("tournament"),
        F.when(wpl, "female").otherwise("male").alias("gender"),
        F.col("team1_region").alias("venue_id"),
        F.col("team1_id"),
        F.col("team2_id"),
        F.lit(None).cast("string").alias("toss_winner_team_id"),
        F.lit(None).cast("string").alias("toss_decision"),
        F.when(status == "F", F.col("team1_id")).when(status == "O", F.col("team2_id")).alias("winner_team_id"),
        F.when(status == "F", 1 + key % 50).cast("int").alias("win_by_runs"),
        F.when(status == "O", 1 + key % 10).cast("int").alias("win_by_wickets"),
        F.when(status == "P", F.when(key % 2 == 0, "tie").otherwise("no result")).alias("result"),
        F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("string").alias("player_of_match_id"),
        F.col("team1_name"),
        F.col("team2_name"),
    )


def a1_dim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a1_matches(spark, sf_dir).select(*DIM_MATCH_COLUMNS)


def a1_times(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """(match_id, times): how often the stored star has each line item of an order, that is once for each of its
    rows of dim_match, met with dim_team by either team's id.  Dealt by order over ``tasks``."""
    teams = a1_dim_team(spark, sf_dir).groupBy("team_id").agg(F.count(F.lit(1)).alias("n"))  # 25 nations at most
    m = a1_matches(spark, sf_dir).select("match_id", "team1_id", "team2_id")
    for side in ("1", "2"):
        m = m.join(F.broadcast(teams.select(F.col("team_id").alias(f"team{side}_id"), F.col("n").alias(f"n{side}"))), f"team{side}_id")
    return m.select("match_id", "n1", "n2").repartition(tasks, "match_id").groupBy("match_id").agg(F.sum(F.col("n1") * F.col("n2")).cast("int").alias("times"))


def a1_fact_ball(spark: SparkSession, sf_dir: str, with_teams: bool = True, tasks: int | None = None) -> DataFrame:
    """One row per line item.

    ``tasks``: the line items are dealt by order over so many tasks before the sequence
    window, as the columns it needs; all else is derived after it, in the same task.

    ``with_teams=False`` leaves batting/bowling team null and skips the join to
    orders; reports that never read the team columns use it so their plan is a
    single fact scan.  Unused columns (the sequence window) are pruned by Catalyst.
    """
    legal, wicket = F.col("l_returnflag") != "R", (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.08)
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), (1 + F.col("l_linenumber") % 2).cast("int").alias("innings_number"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
        legal.alias("legal"), wicket.alias("wicket"),
    )
    if tasks is not None:
        li = li.repartition(tasks, "match_id")
    seq_w = Window.partitionBy("match_id", "innings_number").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    li = li.withColumn("delivery_sequence", F.row_number().over(seq_w).cast("int"))
    line, legal, wicket = F.col("l_linenumber"), F.col("legal"), F.col("wicket")
    batter = F.col("l_partkey") % 50
    bowler = F.col("l_suppkey") % 20
    non_striker = (F.col("l_partkey") + 1) % 50
    batter_runs = (F.floor("l_quantity").cast("int") % 7).cast("int")
    extras = F.when(legal, 0).otherwise(1).cast("int")
    out_id = F.when(wicket, F.when(line % 2 == 1, batter).otherwise(batter + 1))
    f = li.select(
        "match_id",
        "innings_number",
        "delivery_sequence",
        line.cast("int").alias("over_number"),
        F.lit(1).alias("ball_in_over"),
        F.when(line <= 2, "powerplay").when(line <= 5, "middle").otherwise("death").alias("match_phase"),
        F.concat(F.lit("P"), batter.cast("string")).alias("batter_name"),
        batter.alias("batter_id"),
        F.concat(F.lit("P"), bowler.cast("string")).alias("bowler_name"),
        bowler.alias("bowler_id"),
        F.concat(F.lit("P"), non_striker.cast("string")).alias("non_striker_name"),
        non_striker.alias("non_striker_id"),
        batter_runs.alias("batter_runs"),
        extras.alias("extras_runs"),
        (batter_runs + extras).cast("int").alias("total_runs"),
        F.when(~legal, "wides").alias("extras_type"),
        legal.alias("is_legal_delivery"),
        (legal & (batter_runs + extras == 0) & ~wicket).alias("is_dot_ball"),
        (batter_runs == 4).alias("is_boundary_four"),
        (batter_runs == 6).alias("is_boundary_six"),
        wicket.alias("is_wicket"),
        wicket.alias("is_bowler_wicket"),
        F.when(wicket, "bowled").alias("wicket_kind"),
        F.when(wicket, F.concat(F.lit("P"), out_id.cast("string"))).alias("player_out_name"),
        out_id.alias("player_out_id"),
        F.lit(None).cast("string").alias("fielder_name"),
        F.lit(None).cast("bigint").alias("fielder_id"),
    )
    if with_teams:
        teams = a1_matches(spark, sf_dir).select("match_id", "team1_name", "team2_name")
        f = f.join(teams.hint("merge"), "match_id")
        first = F.col("innings_number") == 1
        f = f.withColumn("batting_team", F.when(first, F.col("team1_name")).otherwise(F.col("team2_name"))).withColumn(
            "bowling_team", F.when(first, F.col("team2_name")).otherwise(F.col("team1_name"))
        )
    else:
        f = f.withColumn("batting_team", F.lit(None).cast("string")).withColumn(
            "bowling_team", F.lit(None).cast("string")
        )
    return f.select(*FACT_BALL_COLUMNS)


def a1_dim_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players seen on the A1 fact: batters 0-49 and bowlers 0-19 (ids share one space)."""
    li = table(spark, sf_dir, "lineitem")
    ids = li.select(F.explode(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 20)).alias("player_id")).distinct()
    name = F.concat(F.lit("P"), F.col("player_id").cast("string"))
    return ids.select("player_id", name.alias("player_name"), F.array(name).alias("name_variants"), F.lit("male").alias("gender"))


class Star:
    """The A1 star; each table is planned on first use only."""

    def __init__(self, spark: SparkSession, sf_dir: str, with_teams: bool = True):
        self._spark, self._sf, self._with_teams = spark, sf_dir, with_teams
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def dim_team(self) -> DataFrame:
        return self._get("dim_team", lambda: a1_dim_team(self._spark, self._sf))

    @property
    def dim_venue(self) -> DataFrame:
        return self._get("dim_venue", lambda: a1_dim_venue(self._spark, self._sf))

    @property
    def dim_match(self) -> DataFrame:
        return self._get("dim_match", lambda: a1_dim_match(self._spark, self._sf))

    @property
    def dim_player(self) -> DataFrame:
        return self._get("dim_player", lambda: a1_dim_player(self._spark, self._sf))

    @property
    def fact_ball(self) -> DataFrame:
        return self._get("fact_ball", lambda: a1_fact_ball(self._spark, self._sf, with_teams=self._with_teams))


def a1_star(spark: SparkSession, sf_dir: str, with_teams: bool = True) -> Star:
    return Star(spark, sf_dir, with_teams)


# ----------------------------------------------------------------------------
# A2: ball log from events
# ----------------------------------------------------------------------------

INNINGS_SPLIT = _dt.datetime(2024, 1, 16)


def _a2_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    innings = F.when(F.col("ts") < F.lit(INNINGS_SPLIT).cast("timestamp_ntz"), 1).otherwise(2)
    return e.select(
        "event_id", "ts", "event_type", "value",
        F.expr("user_id div 4").alias("match_id"),
        innings.alias("innings_number"),
        k.alias("k"),
    )


def a2_ball_log(spark: SparkSession, sf_dir: str, keep_k: bool = False) -> DataFrame:
    """The ball log, hash-partitioned by match_id (the one shuffle the derived
    columns need; the sequence window reuses it)."""
    b = _a2_base(spark, sf_dir).repartition("match_id")
    w = Window.partitionBy("match_id", "innings_number").orderBy("ts", "event_id")
    seq = F.row_number().over(w)
    et = F.col("event_type")
    k = F.col("k")
    batter_runs = F.when(et.isin("signup", "error"), 0).otherwise(F.floor("value").cast("int") % 7).cast("int")
    extras = F.when(et == "signup", 1).otherwise(0).cast("int")
    out = b.select(
        "match_id",
        F.col("innings_number").cast("int").alias("innings_number"),
        seq.cast("int").alias("delivery_sequence"),
        F.concat(F.lit("B"), (k % 11).cast("string")).alias("batter_name"),
        F.concat(F.lit("W"), (k % 7).cast("string")).alias("bowler_name"),
        F.concat(F.lit("B"), ((k + 1) % 11).cast("string")).alias("non_striker_name"),
        batter_runs.alias("batter_runs"),
        extras.alias("extras_runs"),
        (batter_runs + extras).cast("int").alias("total_runs"),
        ((et == "error") & (k % 5 == 0)).alias("is_bowler_wicket"),
        (et != "signup").alias("is_legal_delivery"),
        *([k, et.alias("event_type"), F.col("ts")] if keep_k else []),
    )
    seq0 = F.col("delivery_sequence") - 1
    out = out.withColumn("over_number", (F.floor(seq0 / 6) + 1).cast("int")).withColumn(
        "ball_in_over", (seq0 % 6 + 1).cast("int")
    )
    return out


# ----------------------------------------------------------------------------
# A3: match documents rendered from the A2 ball log
# ----------------------------------------------------------------------------

# event name by match_id % 4; object form for even match ids, plain string for odd
A3_EVENTS = ["Indian Premier League", "Women's Premier League", "Multiple Cup", "Big Bash League"]
A3_TRUNCATE_MOD = 9  # match_id % 10 == 9: text cut in half (malformed)
A3_OLD_VERSION_MOD = 8  # match_id % 10 == 8: data_version 0.9.0 (unsupported)
A3_ODD_GENDER_MOD = 6  # match_id % 7 == 6: gender "mixed" (unsupported)


def _json_lit(x) -> Column:
    import json as _json

    return F.lit(_json.dumps(x))


def a3_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per match: (path, text).

    Built from the ball log with per-over, per-innings and per-match
    aggregates.  The ball log is hash-partitioned by match_id, which satisfies
    all three groupings, so no further shuffle happens; each group is one over,
    one innings or one match (bounded by the game).
    """
    b = a2_ball_log(spark, sf_dir, keep_k=True)
    k, et = F.col("k"), F.col("event_type")
    runs = F.struct(F.col("batter_runs").alias("batter"), F.col("extras_runs").alias("extras"), F.col("total_runs").alias("total"))
    d = b.select(
        "match_id", "innings_number", "over_number", "ball_in_over", "batter_name", "bowler_name", "non_striker_name",
        F.to_json(
            F.struct(
                F.col("batter_name").alias("batter"),
                F.col("bowler_name").alias("bowler"),
                F.col("non_striker_name").alias("non_striker"),
                runs.alias("runs"),
                F.when(et == "signup", F.create_map(F.lit("wides"), F.lit(1))).alias("extras"),
                F.when((F.col("batter_runs") == 4) & (k % 3 == 0), F.lit(True)).alias("non_boundary"),
                F.when(
                    F.col("is_bowler_wicket"),
                    F.array(F.struct(F.lit("bowled").alias("kind"), F.col("batter_name").alias("player_out"))),
                ).alias("wickets"),
                F.when(k % 13 == 0, F.create_map(F.lit("role"), F.array().cast("array<string>"))).alias("replacements"),
            )
        ).alias("dj"),
    )
    overs = d.groupBy("match_id", "innings_number", "over_number").agg(
        F.array_sort(F.collect_list(F.struct("ball_in_over", "dj"))).alias("dl")
    )
    overs = overs.select(
        "match_id", "innings_number", "over_number",
        F.concat(
            F.lit('{"over":'), (F.col("over_number") - 1).cast("string"), F.lit(',"deliveries":['),
            F.array_join(F.transform("dl", lambda x: x["dj"]), ","), F.lit("]}"),
        ).alias("oj"),
    )
    inns = overs.groupBy("match_id", "innings_number").agg(F.array_sort(F.collect_list(F.struct("over_number", "oj"))).alias("ol"))
    team = F.when(F.col("innings_number") == 1, "T1").otherwise("T2")
    inns = inns.select(
        "match_id", "innings_number",
        F.concat(F.lit('{"team":"'), team, F.lit('","overs":['), F.array_join(F.transform("ol", lambda x: x["oj"]), ","), F.lit("]}")).alias("ij"),
    )
    by_match = inns.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("innings_number", "ij"))).alias("im"))
    names = b.groupBy("match_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("batter_name", "bowler_name", "non_striker_name"))))).alias("names"),
        F.min("ts").alias("first_ts"),
    )
    m = by_match.join(names, "match_id")
    mid = F.col("match_id")
    mod4 = (mid % 4).cast("int")
    obj_events = F.array(*[_json_lit({"name": e}) for e in A3_EVENTS])
    str_events = F.array(*[_json_lit(e) for e in A3_EVENTS])
    event_json = F.when(mid % 2 == 0, F.element_at(obj_events, mod4 + 1)).otherwise(F.element_at(str_events, mod4 + 1))
    gender = F.when(mid % 7 == A3_ODD_GENDER_MOD, "mixed").when(mod4 == 1, "female").otherwise("male")
    registry = F.to_json(F.map_from_arrays("names", F.transform("names", lambda n: F.concat(F.lit("id-"), n))))
    info = F.concat(
        F.lit('{"event":'), event_json,
        F.lit(',"gender":"'), gender,
        F.lit('","season":"2024","dates":["'), F.date_format("first_ts", "yyyy-MM-dd"),
        F.lit('"],"teams":["T1","T2"],"venue":"Ground '), (mid % 5).cast("string"),
        F.lit('","registry":{"people":'), registry, F.lit("}}"),
    )
    empty = {1: '{"team":"T1","overs":[]}', 2: '{"team":"T2","overs":[]}'}
    innings = F.concat(
        F.coalesce(F.element_at("im", 1), F.lit(empty[1])), F.lit(","), F.coalesce(F.element_at("im", 2), F.lit(empty[2]))
    )
    version = F.when(mid % 10 == A3_OLD_VERSION_MOD, "0.9.0").otherwise("1.1.0")
    text = F.concat(F.lit('{"meta":{"data_version":"'), version, F.lit('"},"info":'), info, F.lit(',"innings":['), innings, F.lit("]}"))
    text = F.when(mid % 10 == A3_TRUNCATE_MOD, F.substring(text, 1, (F.length(text) / 2).cast("int"))).otherwise(text)
    folder = F.when(mod4.isin(0, 2), "ipl").otherwise("other")
    path = F.concat(F.lit("/matches/"), folder, F.lit("/"), mid.cast("string"), F.lit(".json"))
    return m.select(path.alias("path"), text.alias("text"))


# ----------------------------------------------------------------------------
# A1 headers and registry entries for the dimension builders
# ----------------------------------------------------------------------------


def a1_match_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per order, in the shape ``flatten.match_headers`` produces."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    r = F.broadcast(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("team1_region"), "r_name"))
    m = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_mktsegment",
        F.col("c_nationkey").cast("bigint").alias("team1_key"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).alias("team2_key"),
    )
    m = m.join(_a1_teams(spark, sf_dir, "team1"), "team1_key").join(_a1_teams(spark, sf_dir, "team2"), "team2_key").join(r, "team1_region")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    wpl = F.col("o_orderpriority") == "5-LOW"
    return m.select(
        key.cast("string").alias("match_id"),
        key.alias("order_key"),
        F.when(wpl, "Women's Premier League").otherwise("Indian Premier League").alias("event_name"),
        F.when(wpl, "female").otherwise("male").alias("gender"),
        F.year("o_orderdate").cast("string").alias("season"),
        F.to_date("o_orderdate").cast("string").alias("match_date"),
        F.array("team1_name", "team2_name").alias("teams"),
        F.col("r_name").alias("venue"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("city"),
        F.lit(None).cast("string").alias("toss_winner"),
        F.lit(None).cast("string").alias("toss_decision"),
        F.when(status == "F", F.col("team1_name")).when(status == "O", F.col("team2_name")).alias("winner"),
        F.when(status == "F", 1 + key % 50).cast("double").alias("win_by_runs"),
        F.when(status == "O", 1 + key % 10).cast("double").alias("win_by_wickets"),
        F.when(status == "P", F.when(key % 2 == 0, "tie").otherwise("no result")).alias("result"),
        F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("string").alias("player_of_match"),
        F.lit(None).cast("map<string,string>").alias("registry"),
    )


def a1_registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part x orders as registry entries: id = supplier, name = part name,
    order = order key, gender from the A1 tournament rule."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    e = li.join(p.hint("merge"), "l_partkey").join(o.hint("merge"), "l_orderkey")
    return e.select(
        F.col("l_orderkey").alias("order_key"),
        F.when(F.col("o_orderpriority") == "5-LOW", "female").otherwise("male").alias("gender"),
        F.col("p_name").alias("name"),
        F.col("l_suppkey").cast("string").alias("id"),
    )

"""Dimension builders and running-window columns on literal inputs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from crease.operators import derived, dims


def test_season_labels(spark):
    labels = ["2023", "2007/08", "2020/21", "1999/00", "2009 / 10", "23/24", "", " 2016 ", "2023/24/25", None]
    df = spark.createDataFrame([(x,) for x in labels], "s string")
    got = [(r.y, r.e) for r in df.select(dims.season_year(F.col("s")).alias("y"), dims.season_error(F.col("s")).alias("e")).collect()]
    assert got == [
        (2023, None), (2008, None), (2020, None), (1900, None), (2010, None),
        (None, "split"), (None, "empty"), (2016, None), (None, "split"), (None, "empty"),
    ]


def test_season_from_json_number(spark):
    df = spark.createDataFrame([('{"season": 2023}',)], "t string").select(F.from_json("t", "season string").alias("j"))
    assert df.select(dims.season_year(F.col("j.season"))).first()[0] == 2023


def _entries(spark, rows):
    return spark.createDataFrame(rows, "order_key int, gender string, name string, id string")


def test_canonical_player_name_and_first_gender(spark):
    rows = [(1, "", "A", "p1"), (2, "male", "A", "p1"), (3, "female", "AB", "p1"), (4, "male", "AB", "p1"), (5, "male", "ABC", "p1"),
            (1, "female", "B", "p2"), (2, "male", "A", "p2")]
    out = {r.player_id: r for r in dims.build_dim_player(_entries(spark, rows)).collect()}
    assert out["p1"].player_name == "AB" and out["p1"].name_variants == ["A", "AB", "ABC"] and out["p1"].gender == "male"
    assert out["p2"].player_name == "A" and out["p2"].gender == "female"
    conflicts = {r.player_id: r.genders for r in dims.player_gender_conflicts(_entries(spark, rows)).collect()}
    assert conflicts == {"p1": ["female", "male"], "p2": ["female", "male"]}


def _headers(spark, rows):
    schema = ("match_id string, order_key int, event_name string, gender string, season string, match_date string, "
              "teams array<string>, venue string, city string, toss_winner string, toss_decision string, winner string, "
              "win_by_runs double, win_by_wickets double, result string, method string, player_of_match string, "
              "registry map<string,string>")
    return spark.createDataFrame(rows, schema)


def _h(mid, order, teams, venue="V", city=None, winner=None, pom=None, reg=None, event="Indian Premier League", gender="male", season="2024"):
    return (mid, order, event, gender, season, "2024-04-0%d" % order, teams, venue, city, None, None, winner, None, None, None, None, pom, reg)


def test_venue_first_city_in_file_order(spark):
    h = _headers(spark, [_h("1", 1, ["a", "b"]), _h("2", 2, ["a", "b"], city=" X "), _h("3", 3, ["a", "b"], city="Y")])
    (v,) = dims.build_dim_venue(h).collect()
    assert (v.venue_name, v.city) == ("V", "X")


def test_team_aliases_merge_renames_only(spark):
    pairs = [["Royal Challengers Bangalore", "Delhi Daredevils"], ["Royal Challengers Bengaluru", "Delhi Capitals"],
             ["Kings XI Punjab", "Rising Pune Supergiants"], ["Deccan Chargers", "Sunrisers Hyderabad"],
             ["Gujarat Lions", "Gujarat Titans"]]
    h = _headers(spark, [_h(str(i), i, t) for i, t in enumerate(pairs)])
    teams = {r.team_name: r.team_name_variants for r in dims.build_dim_team(h).collect()}
    assert teams["Royal Challengers Bengaluru"] == ["Royal Challengers Bangalore", "Royal Challengers Bengaluru"]
    assert teams["Delhi Capitals"] == ["Delhi Capitals", "Delhi Daredevils"]
    assert "Punjab Kings" in teams and "Rising Pune Supergiant" in teams
    for separate in ("Deccan Chargers", "Sunrisers Hyderabad", "Gujarat Lions", "Gujarat Titans"):
        assert teams[separate] == [separate]


def test_dim_match_keys_and_player_of_match(spark):
    h = _headers(spark, [
        _h("m1", 1, [" Delhi Daredevils ", "", "X"], winner="Delhi Daredevils", pom="A", reg={"A": "id-a"}),
        _h("m2", 2, ["P", "Q"], pom="Z", reg={}, event="Women's Premier League", gender="female"),
        _h("m3", 3, ["P", "Q"], season="23/24"),
    ])
    out = {r.match_id: r for r in dims.build_dim_match(h, keep_errors=True).collect()}
    key = spark.range(1).select(F.substring(F.md5(F.lit("Delhi Capitals")), 1, 8)).first()[0]
    assert out["m1"].team1_id == key and out["m1"].winner_team_id == key and out["m1"].player_of_match_id == "id-a"
    assert out["m1"].team2_id == spark.range(1).select(F.substring(F.md5(F.lit("X")), 1, 8)).first()[0]
    assert out["m2"].player_of_match_id == "" and out["m2"].tournament == "WPL"
    assert out["m3"].season_year is None and out["m3"].season_error == "split"


def _balls(spark, rows):
    schema = ("match_id string, innings_number int, delivery_sequence int, over_number int, ball_in_over int, "
              "batter_name string, batter_runs int, total_runs int, is_bowler_wicket boolean")
    return spark.createDataFrame(rows, schema)


def test_partnership_breaks_on_bowler_wickets_only(spark):
    # ball 2 is a run out (not bowler-credited), ball 4 bowled: segment changes at ball 5 only
    rows = [("m", 1, i, 1, i, "A", 1, 1, i == 4) for i in range(1, 7)]
    out = derived.derived_columns(_balls(spark, rows)).orderBy("delivery_sequence").collect()
    assert [r.partnership_id for r in out] == [0, 0, 0, 0, 1, 1]
    assert [r.partnership_runs_so_far for r in out] == [1, 2, 3, 4, 1, 2]
    assert [r.cumulative_wickets_in_innings for r in out] == [0, 0, 0, 1, 1, 1]


def test_chase_edges_and_decimal_overflow(spark):
    rows = [("m", 1, 1, 1, 1, "A", 6, 10, False), ("m", 1, 2, 1, 2, "A", 6, 10, False),
            ("m", 2, 1, 19, 5, "B", 1, 1, False), ("m", 2, 2, 19, 6, "B", 1, 1, True), ("m", 2, 3, 20, 1, "B", 1, 1, False),
            ("big", 1, 1, 1, 1, "A", 0, 500, False), ("big", 2, 1, 19, 5, "B", 0, 0, False)]
    out = derived.derived_columns(_balls(spark, rows))
    got = {(r.match_id, r.delivery_sequence): r for r in out.where("innings_number = 2").collect()}
    # target 21: (21 - 1) * 6 / 1, null at a zero denominator, (21 - 3) * 6 / -1
    assert got[("m", 1)].required_run_rate == Decimal("120.00")
    assert got[("m", 2)].required_run_rate is None
    assert got[("m", 3)].required_run_rate == Decimal("-108.00")
    assert got[("m", 3)].pressure_index == Decimal("-10.81")  # (-108 - 18/121) * 1/10
    assert got[("big", 1)].required_run_rate is None and got[("big", 1)].required_run_rate_raw == 3006.0
    assert derived.decimal_overflow(out).first().overflow_rows == 1
    inn1 = {r.delivery_sequence: r for r in out.where("innings_number = 1 AND match_id = 'm'").collect()}
    assert inn1[2].cumulative_runs_in_innings == 20 and inn1[2].required_run_rate is None


DERIVED = ["match_id", "innings_number", "delivery_sequence", "cumulative_runs_in_innings", "cumulative_wickets_in_innings",
           "batter_innings_runs_so_far", "partnership_id", "partnership_runs_so_far"]


def _whole_innings(fact):
    """The running columns by plain windows over whole innings."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = ("over_number", "ball_in_over", "delivery_sequence")
    over = lambda *keys: Window.partitionBy("match_id", "innings_number", *keys).orderBy(*order)
    so_far = lambda *keys: over(*keys).rowsBetween(Window.unboundedPreceding, 0)
    wicket = F.col("is_bowler_wicket").cast("int")
    f = fact.withColumn("partnership_id", F.coalesce(F.sum(wicket).over(over().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    f = f.withColumn("cumulative_runs_in_innings", F.sum("total_runs").over(so_far()).cast("int"))
    f = f.withColumn("cumulative_wickets_in_innings", F.sum(wicket).over(so_far()).cast("int"))
    f = f.withColumn("batter_innings_runs_so_far", F.sum("batter_runs").over(so_far("batter_name")).cast("int"))
    return f.withColumn("partnership_runs_so_far", F.sum("total_runs").over(so_far("partnership_id")).cast("int")).select(*DERIVED)


def test_chunks_of_any_length_give_the_same(spark):
    from crease.sources import testdata as td

    ball = td.a2_ball_log(spark, "/root/testdata/sf0.01")
    want = _whole_innings(ball)
    for k in (1, 3, 1000):
        got = derived.derived_columns(ball, overs_per_chunk=k).select(*DERIVED)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, k


def test_an_innings_of_many_overs(spark):
    rows = [("hot", 1, i, (i - 1) // 6 + 1, (i - 1) % 6 + 1, "A" if i % 3 else "B", i % 4, i % 4, i % 50 == 0) for i in range(1, 601)]
    rows += [("hot", 2, i, (i - 1) // 6 + 1, (i - 1) % 6 + 1, "C", 1, 1, False) for i in range(1, 13)]
    fact = _balls(spark, rows)
    got, want = derived.derived_columns(fact), _whole_innings(fact)
    assert "chunk" not in got.columns
    got = got.select(*DERIVED)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

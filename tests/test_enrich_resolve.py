"""Resolvers, enrichment lookups, upsert, cache freshness and HTML attributes."""

from __future__ import annotations

import pytest

import datetime as dt

from pyspark.sql import functions as F

from crease.operators import enrich, resolve


def test_team_resolver_rules(spark):
    teams = spark.createDataFrame([(n,) for n in ["Royal Challengers Bengaluru", "Delhi Capitals", "Mumbai Indians",
                                                  "Gujarat Lions", "Gujarat Titans"]], "team_name string")
    inputs = ["rcb", "Delhi Capitals", "mumbai", "gujarat", "Nobody"]
    out = {r.input_name: r for r in resolve.resolve_teams(resolve.names_frame(spark, inputs), teams, inputs).collect()}
    assert (out["rcb"].team_name, out["rcb"].status) == ("Royal Challengers Bengaluru", "alias")
    assert out["Delhi Capitals"].status == "exact"
    assert (out["mumbai"].team_name, out["mumbai"].status) == ("Mumbai Indians", "substring")
    assert out["gujarat"].team_name is None and out["gujarat"].candidates == ["Gujarat Lions", "Gujarat Titans"]
    assert out["Nobody"].status == "none"


def test_player_resolver_priority(spark):
    players = spark.createDataFrame(
        [("p1", "V Kohli", ["V Kohli", "Virat Kohli"]), ("p2", "RG Sharma", ["RG Sharma"]), ("p3", "Kohli Jr", ["Kohli Jr"])],
        "player_id string, player_name string, name_variants array<string>",
    )
    inputs = ["V Kohli", "Virat Kohli", "sharma", "kohli", "Nobody"]
    out = {r.input_name: r for r in resolve.resolve_players(resolve.names_frame(spark, inputs), players, inputs).collect()}
    assert (out["V Kohli"].player_id, out["V Kohli"].match_rule) == ("p1", "exact")
    assert (out["Virat Kohli"].player_id, out["Virat Kohli"].match_rule) == ("p1", "variant")
    assert (out["sharma"].player_id, out["sharma"].match_rule) == ("p2", "substring")
    assert out["kohli"].player_id == "p1"  # several substring hits: smallest id
    assert out["Nobody"].player_id is None


def test_name_list_parsing(spark):
    df = spark.range(1).select(resolve.parse_name_list(F.lit(" A , ,B\nC \n\n")).alias("n"))
    assert df.first().n == ["A", "B", "C"]


def test_register_lookup_prefers_unique_name_and_last_row(spark):
    players = spark.createDataFrame([("1", "MS Dhoni"), ("2", "R Sharma"), ("3", "Nobody")], "player_id string, player_name string")
    reg = spark.createDataFrame(
        [("Mahendra Singh Dhoni", "MS Dhoni", "111", 1), ("Other", "R Sharma", "", 2), ("Rohit Sharma", "R Sharma", "222", 3),
         ("R Sharma", "x", "999", 4)],
        "name string, unique_name string, key_cricinfo string, file_order int",
    )
    out = {r.player_id: r for r in enrich.enrich_players(players, reg).collect()}
    assert (out["1"].full_name, out["1"].cricinfo_id) == ("Mahendra Singh Dhoni", "111")
    assert (out["2"].full_name, out["2"].cricinfo_id) == ("Rohit Sharma", "222")
    assert out["3"].full_name is None


def test_venue_lookup_normalises_names_and_keeps_existing(spark):
    venues = spark.createDataFrame([("v1", "Wankhede Stadium, Mumbai", None, 1), ("v2", "Eden  Gardens!", None, None), ("v3", "Unknown", None, None)],
                                   "venue_id string, venue_name string, city string, capacity int")
    fact = spark.createDataFrame([("m1", 1, 100), ("m1", 1, 50), ("m2", 1, 201), ("m2", 2, 7)], "match_id string, innings_number int, total_runs int")
    matches = spark.createDataFrame([("m1", "v1"), ("m2", "v1")], "match_id string, venue_id string")
    out = {r.venue_id: r for r in enrich.enrich_venues(venues, fact, matches, enrich.curated_venues(spark)).collect()}
    assert out["v1"].capacity == 1 and out["v1"].pitch_type == "Balanced" and out["v1"].avg_first_innings_score == 176
    assert out["v2"].capacity == 68000
    assert out["v3"].capacity is None and out["v3"].avg_first_innings_score is None
    deduped, repointed = enrich.dedupe_venues(
        spark.createDataFrame([("a", "Kingsmead", 25000), ("b", "Kingsmead, Durban", None)], "venue_id string, venue_name string, capacity int"),
        spark.createDataFrame([("m", "b")], "match_id string, venue_id string"),
    )
    assert [r.venue_id for r in deduped.collect()] == ["a"] and repointed.first().venue_id == "a"


def test_upsert_keeps_newest_version(spark):
    old = spark.createDataFrame([("k1", 1, "a"), ("k2", 1, "b")], "k string, v int, x string")
    new = spark.createDataFrame([("k1", 2, "c"), ("k3", 1, "d")], "k string, v int, x string")
    out = {r.k: r.x for r in enrich.upsert(old, new, ["k"], ["v"]).collect()}
    assert out == {"k1": "c", "k2": "b", "k3": "d"}


def test_cache_snapshot_ttl_and_sentinel(spark):
    rows = [("u1", "body1", 200, dt.datetime(2024, 1, 1), 30, 1), ("u1", "body2", 200, dt.datetime(2024, 1, 5), 30, 2),
            ("u2", "NOT_FOUND", 404, dt.datetime(2024, 1, 30), 30, 3), ("u3", "old", 200, dt.datetime(2023, 1, 1), 30, 4)]
    resp = spark.createDataFrame(rows, "url string, response_body string, status_code int, fetched_at timestamp, ttl_days int, seq int")
    out = {r.url: (r.fresh, r.body) for r in enrich.cache_snapshot(resp, dt.datetime(2024, 1, 31)).collect()}
    assert out == {"u1": (True, "body2"), "u2": (True, None), "u3": (False, None)}


def test_schema_evolution_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    once = enrich.add_columns(df, enrich.PLAYER_ENRICH_COLUMNS)
    twice = enrich.add_columns(once, enrich.PLAYER_ENRICH_COLUMNS)
    assert once.columns == twice.columns == ["id", "name", "cricinfo_id", "full_name"]
    assert enrich.choose_column(once, ["innings", "name"]) == "name"


def test_infobox_capacity(spark):
    box = '<table class="infobox vcard">{}</table>'
    cases = [
        (box.format("<tr><th>Location</th><td>Mumbai</td></tr><tr><th>Capacity</th><td>33,108 (approx)</td></tr>"), 33108),
        ("<html><p>Capacity 5</p></html>", None),
        (box.format("<tr><th>Capacity</th><td>unknown</td></tr>"), None),
        (box.format("<tr><th>Capacity</th><td>unknown</td></tr><tr><th>New capacity</th><td>7</td></tr>"), 7),
        (box.format("<tr><th>Seating <b>CAPACITY</b><td><i>about</i> 1,234<tr><th>x<td>9"), 1234),
        ("<table class='wide infobox'><TR><TH>capacity</TH><TD>8</TD></TR></table>", 8),
        ("<table class=infobox><tr><th>capacity</th><td>6</td></tr></table>", 6),
        ("<table class='infoboxes'><tr><th>capacity</th><td>8</td></tr></table>", None),
        (box.format("<tr><td>5</td></tr><tr><th>Opened</th><td>1890</td></tr>"), None),
        (None, None), ("", None),
        (box.format("<tr><th>Ends</th><td><table><tr><td>2</td></tr></table></td></tr><tr><th>Capacity</th><td>11</td></tr>"), 11),
        (box.format("<tr><th>A</th><td><TABLE><tr><td><table></table></td></tr></TABLE></td></tr>") + "<table><tr><th>Capacity</th><td>5</td></tr></table>", None),
        (box.format("<tr><th>A</th><td><table><tr><th>Capacity</th><td>12</td></tr></table></td></tr>"), 12),
        ("<table><tr><td>" + box.format("<tr><th>Capacity</th><td>13</td></tr>") + "</td></tr></table>", 13),
        ('<table class="infobox"><tr><th>Capacity</th><td>14</td></tr>', 14),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    found = {r.i: r.n for r in df.select("i", enrich.infobox_number(df.html).alias("n")).collect()}
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]


def test_register_is_read_by_column_name(spark, tmp_path):
    (tmp_path / "people.csv").write_text(
        "identifier,name,unique_name,key_bcci,key_bigbash,key_cricinfo\n1,A Name,A Uname,b1,g1,c1\n2,B Name,B Uname,b2,,c2\n")
    rows = enrich.read_register(spark, str(tmp_path / "people.csv")).orderBy("identifier").collect()
    assert [(r.identifier, r.name, r.unique_name, r.key_cricinfo) for r in rows] == [("1", "A Name", "A Uname", "c1"), ("2", "B Name", "B Uname", "c2")]


def test_infobox_values_runs_distributed(spark):
    pages = spark.createDataFrame([(1, '<table class="infobox"><tr><th>Seating capacity</th><td>1,234</td></tr></table>'), (2, "<p/>")],
                                  "page_id long, html string")
    out = {r.page_id: r.capacity for r in enrich.infobox_values(pages).collect()}
    assert out == {1: 1234, 2: None}


def test_register_lookup_top_n_prefix(spark):
    players = spark.createDataFrame([("1", "B"), ("2", "A"), ("3", "C")], "player_id string, player_name string")
    reg = spark.createDataFrame([(n, n, f"k{n}", i) for i, n in enumerate("ABC")], "name string, unique_name string, key_cricinfo string, file_order int")
    out = {r.player_id: r.cricinfo_id for r in enrich.enrich_players(players, reg, top_n=2).collect()}
    assert out == {"2": "kA", "1": "kB", "3": None}


def test_margin_text_variants(spark):
    from crease.operators.reports import margin_text

    df = spark.createDataFrame([(10, None, None), (None, 3, None), (0, 0, "tie"), (None, None, None)],
                               "r int, w int, res string")
    std = [x[0] for x in df.select(margin_text("r", "w", "res")).collect()]
    alt = [x[0] for x in df.select(margin_text("r", "w", None, otherwise="no result")).collect()]
    assert std == ["by 10 runs", "by 3 wickets", "tie", "n/a"]
    assert alt == ["by 10 runs", "by 3 wickets", "no result", "no result"]


AUCTION = "player_name string, season string, team string, sold_price_cr double, base_price_cr double, is_retained boolean, file_order long"


def test_auction_merge_rewrites_touched_seasons_alone(spark, tmp_path):
    from decimal import Decimal

    from crease.operators import auction

    path = str(tmp_path / "auction")
    assert auction.read_auction(spark, path).count() == 0
    first = [("A", "2022", "T", 1.5, 0.2, True, 1), ("A", "2022", "U", 2.5, 0.2, True, 2), ("B", "2022", "T", 3.0, 0.5, False, 3), ("A", "2023", "T", 9.0, 1.0, True, 4)]
    assert auction.merge_auction(spark, path, spark.createDataFrame(first, AUCTION), "file_order") == ["2022", "2023"]
    files = lambda season: {p: p.stat().st_mtime_ns for p in (tmp_path / "auction" / f"season={season}").iterdir()}
    kept, other = files("2022"), files("2023")
    second = [("A", "2023", "V", 7.25, 1.0, None, 1), ("C", "2024", "T", 1.0, 1.0, False, 1)]
    assert auction.merge_auction(spark, path, spark.createDataFrame(second, AUCTION), "file_order") == ["2023", "2024"]
    assert files("2022") == kept and files("2023") != other
    rows = {(r.player_name, r.season): (r.team, r.sold_price_cr, r.is_retained) for r in auction.read_auction(spark, path).collect()}
    assert rows == {
        ("A", "2022"): ("U", Decimal("2.50"), True), ("B", "2022"): ("T", Decimal("3.00"), False),
        ("A", "2023"): ("V", Decimal("7.25"), None), ("C", "2024"): ("T", Decimal("1.00"), False),
    }
    with pytest.raises(AssertionError, match="without"):
        auction.merge_auction(spark, path, spark.createDataFrame([(None, "2024", "T", 1.0, 1.0, True, 1)], AUCTION), "file_order")
    assert auction.merge_auction(spark, path, spark.createDataFrame([], AUCTION), "file_order") == []
    assert auction.read_auction(spark, path).count() == 4


def test_orphan_samples(spark):
    from crease.operators import quality

    fact = spark.createDataFrame([(m, f"x{m % 4}", "n", None if m % 2 else "y") for m in range(20)], "match_id long, a string, a_name string, b string")
    dim = spark.createDataFrame([("x0",), ("x0",)], "k string")
    refs, shown = {"a": (dim, "k"), "b": (dim, "k")}, {"a": ("match_id", "a_name"), "b": ("match_id",)}
    got = {r.fk_column: tuple(r)[1:] for r in quality.orphan_samples(fact, refs, shown, samples=2).collect()}
    assert got == {"a": (4, 3, 15, "x1,x2", "1,n"), "b": (1, 1, 10, "y", "0")}
    empty = {r.fk_column: tuple(r)[1:] for r in quality.orphan_samples(fact.limit(0), refs, shown).collect()}
    assert empty == {"a": (0, 0, 0, None, None), "b": (0, 0, 0, None, None)}

"""Enrichment keys (FIXTURES: register from customer rows against nation players, venues =
region names plus "region, nation" variants with literal metadata for three regions,
orders upserted by customer, nation schema evolution, events as a response cache,
pages for HTML attributes)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crease.operators import auction, enrich
from crease.oracle.adapters import A1, with_ctes
from crease.plans.catalog import hu, register, values_sql
from crease.plans import fixtures as fx
from crease.session import scratch_path
from crease.sources import testdata as td

# literal metadata for three regions (test parameters; the normal form of the
# name is the lookup key, so "Africa" and "EUROPE!" still match)
REGION_METADATA = [
    ("Africa", 1000, 1.5, 2.5, 1901, "Balanced"),
    ("asia", 2000, 3.5, 4.5, 1902, "Flat"),
    ("EUROPE!", 3000, 5.5, 6.5, 1903, "Spin-friendly"),
]
CACHE_AS_OF = dt.datetime(2024, 1, 31)
CACHE_TTL_DAYS = 10


# ---------------------------------------------------------------- J12
REGISTER_SQL = """WITH reg AS (
  SELECT n.n_name AS name, CASE WHEN c.c_custkey % 2 = 0 THEN n.n_name ELSE c.c_name END AS unique_name,
         CAST(c.c_custkey AS VARCHAR) AS key_cricinfo, c.c_custkey AS file_order
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
bu AS (SELECT unique_name AS lookup, arg_max(name, file_order) AS full_name, arg_max(key_cricinfo, file_order) AS cid FROM reg GROUP BY unique_name),
bn AS (SELECT name AS lookup, arg_max(name, file_order) AS full_name, arg_max(key_cricinfo, file_order) AS cid FROM reg GROUP BY name)
SELECT n.n_nationkey AS player_id, n.n_name AS player_name,
  CASE WHEN bu.lookup IS NOT NULL THEN bu.full_name ELSE bn.full_name END AS full_name,
  NULLIF(CASE WHEN bu.lookup IS NOT NULL THEN bu.cid ELSE bn.cid END, '') AS cricinfo_id
FROM nation n LEFT JOIN bu ON bu.lookup = n.n_name LEFT JOIN bn ON bn.lookup = n.n_name"""


def _register_rows(spark, sf):
    n = td.table(spark, sf, "nation")
    c = td.table(spark, sf, "customer")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("identifier"),
        F.col("n_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.col("c_name")).alias("unique_name"),
        F.col("c_custkey").cast("string").alias("key_cricinfo"),
        F.col("c_custkey").alias("file_order"),
    )


def _nation_players(spark, sf):
    n = td.table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").alias("player_id"), F.col("n_name").alias("player_name"),
        F.array("n_name").alias("name_variants"), F.lit("male").alias("gender"),
    )


@register("register_match", REGISTER_SQL)
def q_register_match(spark, sf):
    return enrich.enrich_players(_nation_players(spark, sf), _register_rows(spark, sf)).select(
        "player_id", "player_name", "full_name", "cricinfo_id"
    )


@register("register_csv", REGISTER_SQL)
def q_register_csv(spark, sf):
    """The register written as CSV files (sorted, so file order = register order) and read back.

    The files hold more columns than are read, in another order."""
    root = scratch_path(spark, "register-csv")
    rows = _register_rows(spark, sf).orderBy("file_order").select(
        "identifier", "name", "unique_name", F.lit("bcci").alias("key_bcci"), "key_cricinfo", F.lit(7).alias("key_other")
    )
    rows.write.option("header", True).csv(root)
    reg = enrich.read_register(spark, root)
    return enrich.enrich_players(_nation_players(spark, sf), reg).select("player_id", "player_name", "full_name", "cricinfo_id")


# ---------------------------------------------------------------- J13, A12, J8
def _venues(spark, sf):
    r = td.table(spark, sf, "region")
    n = td.table(spark, sf, "nation")
    base = r.select(
        F.col("r_regionkey").alias("venue_id"), F.col("r_name").alias("venue_name"),
        F.when(F.col("r_name") != "AFRICA", F.lower("r_name")).alias("city"),
    )
    variants = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        (F.col("n_nationkey") + 100).alias("venue_id"),
        F.concat(F.col("r_name"), F.lit(", "), F.col("n_name")).alias("venue_name"),
        F.lit(None).cast("string").alias("city"),
    )
    return base.unionByName(variants)


def _enriched(spark, sf):
    s = fx.a1_star(spark, sf)
    cur = enrich.curated_venues(spark, REGION_METADATA)
    return enrich.enrich_venues(_venues(spark, sf), s.fact_ball, s.dim_match, cur), s


VENUE_SQL = [
    """venues AS (
  SELECT r_regionkey AS venue_id, r_name AS venue_name, CASE WHEN r_name <> 'AFRICA' THEN lower(r_name) END AS city FROM region
  UNION ALL SELECT n.n_nationkey + 100, r.r_name || ', ' || n.n_name, CAST(NULL AS VARCHAR)
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "cur_raw AS " + values_sql(REGION_METADATA, "venue_name, capacity, lat, lon, established_year, pitch_type"),
    """cur AS (SELECT trim(regexp_replace(lower(venue_name), '[^a-z0-9]+', ' ', 'g')) AS venue_key, * FROM cur_raw)""",
    f"""avgs AS (
  SELECT m.venue_id, CAST({hu('avg(t.total)', 0)} AS INTEGER) AS avg_first_innings_score
  FROM (SELECT match_id, SUM(total_runs) AS total FROM a1_f WHERE innings_number = 1 GROUP BY match_id) t
  JOIN dim_match m ON m.match_id = t.match_id GROUP BY m.venue_id)""",
    """enriched AS (
  SELECT v.venue_id, v.venue_name, v.city, CAST(c.capacity AS INTEGER) AS capacity, CAST(c.established_year AS INTEGER) AS established_year,
         c.pitch_type, a.avg_first_innings_score, CAST(c.lat AS DOUBLE) AS lat, CAST(c.lon AS DOUBLE) AS lon
  FROM venues v LEFT JOIN cur c ON c.venue_key = trim(regexp_replace(lower(v.venue_name), '[^a-z0-9]+', ' ', 'g'))
  LEFT JOIN avgs a ON a.venue_id = v.venue_id)""",
]


@register("venue_enrich", with_ctes("SELECT * FROM enriched", A1, VENUE_SQL))
def q_venue_enrich(spark, sf):
    v, _ = _enriched(spark, sf)
    return v


@register(
    "venue_dedupe",
    with_ctes(
        """SELECT v.venue_id, v.venue_name, v.capacity, COALESCE(c.n, 0) AS n_matches
FROM enriched v LEFT JOIN (
  SELECT COALESCE(p.canonical_id, m.venue_id) AS venue_id, COUNT(*) AS n
  FROM dim_match m LEFT JOIN pairs p ON p.duplicate_id = m.venue_id GROUP BY 1) c ON c.venue_id = v.venue_id
WHERE v.venue_id NOT IN (SELECT duplicate_id FROM pairs)""",
        A1,
        VENUE_SQL
        + [
            """pairs AS (
  SELECT c.venue_id AS canonical_id, d.venue_id AS duplicate_id FROM enriched d JOIN enriched c
    ON c.venue_name = split_part(d.venue_name, ',', 1)
  WHERE d.venue_name LIKE '%, %' AND c.capacity IS NOT NULL AND c.venue_id <> d.venue_id)"""
        ],
    ),
)
def q_venue_dedupe(spark, sf):
    v, s = _enriched(spark, sf)
    venues, matches = enrich.dedupe_venues(v, s.dim_match)
    counts = matches.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    out = venues.join(counts, "venue_id", "left")
    return out.select("venue_id", "venue_name", "capacity", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_matches"))


# ---------------------------------------------------------------- K6
UPSERT_SPLIT = dt.datetime(1998, 1, 1)


@register(
    "upsert_latest",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""",
)
def q_upsert_latest(spark, sf):
    o = td.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    split = F.lit(UPSERT_SPLIT).cast("timestamp_ntz")
    existing = o.where(F.col("o_orderdate") < split)
    updates = o.where(F.col("o_orderdate") >= split)
    out = enrich.upsert(existing, updates, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")


AUCTION_ROWS = """SELECT 'P' || CAST(o_custkey AS {s}) AS player_name, CAST(year(o_orderdate) AS {s}) AS season, o_orderpriority AS team,
  CAST(o_orderkey % 1000 AS DECIMAL(5,2)) AS sold_price_cr, CAST(o_orderkey % 100 AS DECIMAL(5,2)) AS base_price_cr,
  o_orderstatus = 'F' AS is_retained, o_orderkey AS file_order FROM orders"""


@register(
    "auction_upsert",
    f"""SELECT player_name, season, team, sold_price_cr, base_price_cr, is_retained FROM (
  SELECT *, row_number() OVER (PARTITION BY player_name, season ORDER BY batch DESC, file_order DESC) AS rn FROM (
    SELECT *, CASE WHEN file_order % 3 <> 0 THEN 1 WHEN season IN ('1996', '1997') THEN 2 END AS batch
    FROM ({AUCTION_ROWS.format(s='VARCHAR')})) WHERE batch IS NOT NULL) WHERE rn = 1""",
)
def q_auction_upsert(spark, sf):
    """K6 on (player_name, season): a first load of all seasons, then rows of two seasons merged into their partitions."""
    td.table(spark, sf, "orders").createOrReplaceTempView("auction_orders")
    rows = spark.sql(AUCTION_ROWS.format(s="STRING").replace("FROM orders", "FROM auction_orders"))
    path = scratch_path(spark, "auction")
    auction.merge_auction(spark, path, rows.where("file_order % 3 <> 0"), "file_order")
    auction.merge_auction(spark, path, rows.where("file_order % 3 = 0 AND season IN ('1996', '1997')"), "file_order")
    return auction.read_auction(spark, path)


# ---------------------------------------------------------------- K7, K8
@register(
    "schema_evolve",
    """SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS n_comment, CAST(NULL AS INTEGER) AS n_capacity,
  n_regionkey AS picked FROM nation""",
)
def q_schema_evolve(spark, sf):
    n = td.table(spark, sf, "nation")
    df = enrich.add_columns(n, {"n_regionkey": "int", "n_comment": "string", "n_capacity": "int"})
    picked = enrich.choose_column(df, ["n_region", "n_regionkey"])
    return df.withColumn("picked", F.col(picked))


# ---------------------------------------------------------------- Q13
@register(
    "cache_snapshot",
    f"""WITH resp AS (
  SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN event_type = 'error' THEN '{enrich.NOT_FOUND_SENTINEL}' ELSE props END AS response_body,
         CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status_code, ts AS fetched_at, event_id AS seq
  FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS rn FROM resp) WHERE rn = 1)
SELECT url, fetched_at, status_code,
  TIMESTAMP '{CACHE_AS_OF:%Y-%m-%d %H:%M:%S}' <= fetched_at + INTERVAL {CACHE_TTL_DAYS} DAY AS fresh,
  CASE WHEN TIMESTAMP '{CACHE_AS_OF:%Y-%m-%d %H:%M:%S}' <= fetched_at + INTERVAL {CACHE_TTL_DAYS} DAY
        AND response_body <> '{enrich.NOT_FOUND_SENTINEL}' THEN response_body END AS body
FROM latest""",
)
def q_cache_snapshot(spark, sf):
    e = td.table(spark, sf, "events")
    err = F.col("event_type") == "error"
    resp = e.select(
        F.col("user_id").cast("string").alias("url"),
        F.when(err, F.lit(enrich.NOT_FOUND_SENTINEL)).otherwise(F.col("props")).alias("response_body"),
        F.when(err, 404).otherwise(200).alias("status_code"),
        F.col("ts").alias("fetched_at"),
        F.lit(CACHE_TTL_DAYS).alias("ttl_days"),
        F.col("event_id").alias("seq"),
    )
    return enrich.cache_snapshot(resp, CACHE_AS_OF)


# ---------------------------------------------------------------- P17, P18
@register(
    "html_attribute",
    r"""SELECT page_id, title,
  CASE WHEN replace(regexp_extract(title, '(\d[\d,]*)', 1), ',', '') <> ''
       THEN TRY_CAST(replace(regexp_extract(title, '(\d[\d,]*)', 1), ',', '') AS INTEGER) END AS title_number
FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)""",
)
def q_html_attribute(spark, sf):
    p = td.table(spark, sf, "pages")
    return p.select("page_id", enrich.html_title(F.col("html")).alias("title"), enrich.title_number(F.col("html")).alias("title_number"))


# every page, six of seven with an infobox rendered from its id: a plain one, one with nested markup and a thousands
# comma, one whose first matching row has no number, one without the row, a table of another class, and one with
# tables inside the cells of earlier rows, followed by a table of its own
INFOBOX_SQL = """SELECT page_id, CASE page_id % 7
  WHEN 0 THEN 1000 + page_id WHEN 1 THEN 12000 + page_id % 1000 WHEN 2 THEN page_id WHEN 6 THEN 300 + page_id END AS capacity FROM pages"""


def _with_infobox(pages):
    n = F.col("page_id")
    comma = F.format_number(12000 + n % 1000, 0)
    open_box, close = "<table class='infobox vcard'><tr><th colspan=2>Ground</th></tr>", "</table>"
    row = lambda head, *value: F.concat(F.lit(f"<tr><th scope='row'>{head}</th><td>"), *value, F.lit("</td></tr>"))
    box = (
        F.when(n % 7 == 0, F.concat(F.lit(open_box), row("Capacity", (1000 + n).cast("string")), F.lit(close)))
        .when(n % 7 == 1, F.concat(
            F.lit('<TABLE id="t" class="wide infobox"><tbody><TR><td>no header</td></TR>'),
            row("Seating <b>CAPACITY</b>", F.lit("<i>about</i> "), comma, F.lit(" (1999)")), F.lit("</tbody></TABLE>")))
        .when(n % 7 == 2, F.concat(F.lit(open_box), row("Capacity", F.lit("unknown")), row("Capacity now", n.cast("string")), F.lit(close)))
        .when(n % 7 == 3, F.concat(F.lit(open_box), row("Opened", F.lit("1890")), F.lit(close)))
        .when(n % 7 == 4, F.concat(F.lit("<table class='infoboxes'>"), row("Capacity", F.lit("5")), F.lit(close)))
        .when(n % 7 == 6, F.concat(
            F.lit(open_box), row("Tenants", F.lit("<table><tr><td>A<TABLE><tr><td>B</td></tr></TABLE></td></tr></table>")),
            row("Layout", F.lit("<table class='infobox'><tr><th>Ends</th><td>2</td></tr></table>")),
            row("Capacity", (300 + n).cast("string")), F.lit(close), F.lit("<table><tr><th>Capacity</th><td>1</td></tr></table>")))
        .otherwise(F.lit(""))
    )
    return pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), box).alias("html"))


@register("html_infobox", INFOBOX_SQL)
def q_html_infobox(spark, sf):
    """P18 over every page, with an infobox appended to most."""
    pages = _with_infobox(td.table(spark, sf, "pages"))
    return pages.select("page_id", enrich.infobox_number(F.col("html")).cast("bigint").alias("capacity"))


# ---------------------------------------------------------------- A13 over every enriched table
def _validation_sql() -> str:
    from crease.oracle.adapters import A2
    from crease.plans.q_derived import RUNNING_CTES

    chase = with_ctes("SELECT * FROM chase", A2, RUNNING_CTES)
    venues = with_ctes("SELECT * FROM enriched", A1, VENUE_SQL)
    parts = [
        ("fact_ball", "required_run_rate", chase), ("fact_ball", "pressure_index", chase),
        ("dim_player", "full_name", REGISTER_SQL), ("dim_player", "cricinfo_id", REGISTER_SQL),
        ("dim_venue", "capacity", venues),
    ]
    body = "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS col_name, COUNT({c}) AS populated, COUNT(*) AS total FROM ({q})" for t, c, q in parts
    )
    return f"SELECT *, populated = 0 AS zero_populated FROM ({body})"


@register("enrichment_validation", _validation_sql())
def q_enrichment_validation(spark, sf):
    """Populated counts of every enriched column, per table (warn on zero)."""
    from crease.operators import derived, quality

    fact = derived.derived_columns(td.a2_ball_log(spark, sf))
    players = q_register_match(spark, sf)
    venues, _ = _enriched(spark, sf)
    out = None
    for table, df, cols in (("fact_ball", fact, ["required_run_rate", "pressure_index"]),
                            ("dim_player", players, ["full_name", "cricinfo_id"]),
                            ("dim_venue", venues, ["capacity"])):
        part = quality.non_null_counts(df, cols).select(F.lit(table).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out

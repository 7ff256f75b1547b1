"""Post-load enrichment.

The reference updates rows one at a time; here every step is a DataFrame ->
DataFrame function made of joins and aggregates:

* reference-data lookups are joins against a keyed, de-duplicated table
  ("last row wins" = ``max_by`` on the file order, a partial aggregate);
* "fill only if NULL" is ``coalesce(existing, looked_up)``;
* upserts are "newest version per key" aggregates over the union of old and
  new rows (``MERGE`` is not available on plain Parquet);
* the HTTP fetching and SQLite response cache of the reference are not built
  (single-machine network client); their data rule survives as
  ``cache_snapshot`` over a response table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.numeric import round_half_up
from crease.functions.text import first_integer, venue_key
from crease.operators.venue_reference import CURATED_VENUES

# --- fixed values (must equal the reference's) ---
NOT_FOUND_SENTINEL = "NOT_FOUND"
DEFAULT_TTL_DAYS = 30
# --- end fixed values ---

VENUE_ATTRS = ["capacity", "established_year", "pitch_type", "lat", "lon"]


# ----------------------------------------------------------------------------
# K7, K8: schema evolution
# ----------------------------------------------------------------------------


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """K7: add each missing column as typed NULL; existing columns are left alone (idempotent)."""
    present = set(df.columns)
    for name, dtype in columns.items():
        if name not in present:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def choose_column(df: DataFrame, candidates: list[str]) -> str:
    """K8: first candidate column that exists (driver-side schema check, no job)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"No candidate columns found: {candidates}")


PLAYER_ENRICH_COLUMNS = {"cricinfo_id": "string", "full_name": "string"}
VENUE_ENRICH_COLUMNS = {
    "capacity": "int", "established_year": "int", "pitch_type": "string",
    "avg_first_innings_score": "int", "lat": "double", "lon": "double",
}
FACT_ENRICH_COLUMNS = {
    "cumulative_runs_in_innings": "int", "cumulative_wickets_in_innings": "int",
    "required_run_rate": "decimal(5,2)", "batter_innings_runs_so_far": "int",
    "partnership_runs_so_far": "int", "pressure_index": "decimal(5,2)",
}


# ----------------------------------------------------------------------------
# K6: upsert
# ----------------------------------------------------------------------------


def latest_per_key(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key by ``version`` (ties: the later columns of the version decide).

    ``max_by`` is a partial aggregate: a key with a huge number of versions
    is reduced map-side, never gathered in one task.
    """
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in version]))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """K6: ``INSERT ... ON CONFLICT (keys) DO UPDATE`` as union + newest version per key."""
    return latest_per_key(existing.unionByName(updates), keys, version)


# ----------------------------------------------------------------------------
# People register
# ----------------------------------------------------------------------------


def _last_by(register: DataFrame, key: str, order: str) -> DataFrame:
    rec = F.max_by(F.struct("name", "key_cricinfo"), F.col(order))
    return register.groupBy(key).agg(rec.alias("r")).select(F.col(key).alias("lookup"), F.col("r.name").alias("full_name"), F.col("r.key_cricinfo").alias("cricinfo_id"))


def enrich_players(dim_player: DataFrame, register: DataFrame, order: str = "file_order", top_n: int | None = None) -> DataFrame:
    """Match players to the register by ``unique_name`` first, then ``name``.

    Duplicate register keys: the last row (by ``order``) wins.  Existing
    non-null values are kept; an empty cricinfo id counts as missing.
    ``top_n`` (O5) limits the lookup to the first n players by name; the
    other players pass through unchanged.
    """
    p = add_columns(dim_player, PLAYER_ENRICH_COLUMNS)
    if top_n is not None and top_n > 0:
        chosen = p.orderBy("player_name", "player_id").limit(top_n).select("player_id")
        rest = p.join(chosen, "player_id", "left_anti")
        return enrich_players(p.join(chosen, "player_id", "left_semi"), register, order).unionByName(rest.select(*p.columns))
    by_unique = _last_by(register, "unique_name", order)
    by_name = _last_by(register, "name", order)
    u = by_unique.select(F.col("lookup").alias("player_name"), F.col("full_name").alias("u_full"), F.col("cricinfo_id").alias("u_id"), F.lit(True).alias("u_hit"))
    n = by_name.select(F.col("lookup").alias("player_name"), F.col("full_name").alias("n_full"), F.col("cricinfo_id").alias("n_id"))
    j = p.join(u, "player_name", "left").join(n, "player_name", "left")
    hit_u = F.coalesce(F.col("u_hit"), F.lit(False))
    full = F.when(hit_u, F.col("u_full")).otherwise(F.col("n_full"))
    cid = F.nullif(F.when(hit_u, F.col("u_id")).otherwise(F.col("n_id")), F.lit(""))
    j = j.withColumn("full_name", F.coalesce("full_name", full)).withColumn("cricinfo_id", F.coalesce("cricinfo_id", cid))
    return j.select(*p.columns)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The people register CSV (header row, all text) with its file order.

    Columns are found by their name in the header, wherever they stand; other columns
    are ignored, and a missing one raises.  Without a schema every column is text."""
    df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    df = df.select("identifier", "name", "unique_name", "key_cricinfo", "_metadata")
    # file order = (file path, position in the file): splits of one file keep
    # their offset order, so the generated id increases along each file
    return df.withColumn("file_order", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))


# ----------------------------------------------------------------------------
# venues
# ----------------------------------------------------------------------------


def curated_venues(spark: SparkSession, rows=CURATED_VENUES) -> DataFrame:
    """The curated metadata keyed by the normal form of the name (later entries win)."""
    schema = "venue_name string, capacity int, lat double, lon double, established_year int, pitch_type string, pos int"
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    best = F.max_by(F.struct(*VENUE_ATTRS), F.col("pos"))
    return df.groupBy(venue_key("venue_name").alias("venue_key")).agg(best.alias("m")).select(
        "venue_key", *[F.col("m")[c].alias(f"cur_{c}") for c in VENUE_ATTRS]
    )


def first_innings_average(fact_ball: DataFrame, dim_match: DataFrame) -> DataFrame:
    """Per venue, the average first-innings total, rounded to an integer."""
    totals = fact_ball.where(F.col("innings_number") == 1).groupBy("match_id").agg(F.sum("total_runs").alias("innings_total"))
    matches = dim_match.select("match_id", "venue_id").hint("merge")  # they grow with the data: never a broadcast
    per_venue = totals.join(matches, "match_id").groupBy("venue_id").agg(
        F.avg("innings_total").alias("avg_total")
    )
    return per_venue.select("venue_id", round_half_up("avg_total", 0).cast("int").alias("avg_first_innings_score"))


def enrich_venues(dim_venue: DataFrame, fact_ball: DataFrame, dim_match: DataFrame, curated: DataFrame) -> DataFrame:
    """J13 + J8: fill missing attributes from the curated table (by normalised name) and
    recompute the first-innings average for every venue (NULL without matches)."""
    v = add_columns(dim_venue, VENUE_ENRICH_COLUMNS)
    v = v.withColumn("venue_key", venue_key("venue_name")).join(curated, "venue_key", "left")
    for c in VENUE_ATTRS:
        v = v.withColumn(c, F.coalesce(F.col(c), F.col(f"cur_{c}").cast(VENUE_ENRICH_COLUMNS[c])))
    v = v.drop("avg_first_innings_score").join(first_innings_average(fact_ball, dim_match), "venue_id", "left")
    return v.select(*add_columns(dim_venue, VENUE_ENRICH_COLUMNS).columns)


def venue_duplicates(dim_venue: DataFrame) -> DataFrame:
    """("X, City", "X") pairs where "X" is a venue with a known capacity."""
    dup = dim_venue.where(F.col("venue_name").like("%, %")).select(
        F.col("venue_id").alias("duplicate_id"), F.col("venue_name").alias("duplicate_name"),
        F.split_part(F.col("venue_name"), F.lit(","), F.lit(1)).alias("base"),
    )
    canon = dim_venue.where(F.col("capacity").isNotNull()).select(
        F.col("venue_id").alias("canonical_id"), F.col("venue_name").alias("base")
    )
    return dup.join(canon, "base").where(F.col("canonical_id") != F.col("duplicate_id")).select(
        "canonical_id", "duplicate_id", F.col("base").alias("canonical_name"), "duplicate_name"
    )


def dedupe_venues(dim_venue: DataFrame, dim_match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q12: fold duplicates into their canonical venue: (venues without duplicates,
    matches with venue ids repointed)."""
    pairs = venue_duplicates(dim_venue)
    venues = dim_venue.join(pairs.select(F.col("duplicate_id").alias("venue_id")), "venue_id", "left_anti")
    remap = pairs.select(F.col("duplicate_id").alias("venue_id"), "canonical_id")
    matches = dim_match.join(remap, "venue_id", "left").withColumn("venue_id", F.coalesce("canonical_id", "venue_id")).drop("canonical_id")
    return venues, matches.select(*dim_match.columns)


# ----------------------------------------------------------------------------
# Q13: cached responses
# ----------------------------------------------------------------------------


def cache_snapshot(responses: DataFrame, as_of: _dt.datetime, sentinel: str = NOT_FOUND_SENTINEL) -> DataFrame:
    """Q13: newest response per URL; fresh while ``as_of <= fetched_at + ttl_days``;
    the body is NULL when stale or when it is the not-found sentinel.

    responses: url, response_body, status_code, fetched_at, ttl_days (and an
    optional tie-break column ``seq``).
    """
    version = ["fetched_at", "seq"] if "seq" in responses.columns else ["fetched_at"]
    latest = latest_per_key(responses, ["url"], version)
    ttl = F.coalesce(F.col("ttl_days"), F.lit(DEFAULT_TTL_DAYS))
    expires = F.col("fetched_at") + F.make_dt_interval(days=ttl)
    fresh = F.lit(as_of).cast(latest.schema["fetched_at"].dataType) <= expires
    body = F.when(fresh & (F.col("response_body") != sentinel), F.col("response_body"))
    return latest.select("url", "fetched_at", "status_code", fresh.alias("fresh"), body.alias("body"))


# ----------------------------------------------------------------------------
# Attributes out of HTML
# ----------------------------------------------------------------------------


def html_title(html: Column) -> Column:
    """Text of the first <title> element (raw, entities not decoded)."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def title_number(html: Column) -> Column:
    """P17 on the page title: first integer, thousands commas allowed."""
    return first_integer(html_title(html))


def markup_text(html: Column) -> Column:
    """Visible text of a piece of markup: tags become blanks, blanks are merged."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


INFOBOX_TAG = r"""(?is)^<table\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?infobox(?:\s[^"]*)?"|'(?:[^']*\s)?infobox(?:\s[^']*)?'|infobox(?=[\s>]))[^>]*>"""
TABLE_EDGES = r"(?i)(?=<table\b)|(?<=</table>)"


def infobox(html: Column) -> Column:
    """Markup of the first table of class infobox up to the end tag that matches its start, tables in its cells included.

    The page is cut before each table tag and after each end tag; a scan over the pieces
    counts how many tables are open (-1 once the box is closed).  A box that never ends
    goes on to the end of the page.  '' without one."""

    def step(at: Column, piece: Column) -> Column:
        opens = F.when(piece.rlike(r"(?i)^<table\b"), 1).otherwise(0)
        closes = F.when(piece.rlike(r"(?i)</table>$"), 1).otherwise(0)
        depth = at["depth"] + opens - closes
        inside = F.struct(F.when(depth <= 0, -1).otherwise(depth).alias("depth"), F.concat(at["text"], piece).alias("text"))
        waiting = (at["depth"] < 0) | ((at["depth"] == 0) & ~piece.rlike(INFOBOX_TAG))
        return F.when(waiting, at).otherwise(inside)

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(F.split(html, TABLE_EDGES), start, step)["text"]


def infobox_number(html: Column, header_word: str = "capacity") -> Column:
    """First integer of the first infobox row whose header mentions ``header_word`` and whose value has one.

    Expressions alone: the first table of class infobox, cut before each row; a row's
    header and value are its first th and td, which end where the next cell or row begins.
    Rows of a table inside a cell are rows as well."""
    pieces = F.split(infobox(html), r"(?i)<tr\b[^>]*>")
    rows = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    cell = lambda row, tag: F.regexp_extract(row, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}|<t[dhr]\b|$)", 1)
    fitting = F.filter(rows, lambda r: F.contains(F.lower(markup_text(cell(r, "th"))), F.lit(header_word.lower())))
    numbers = F.transform(fitting, lambda r: first_integer(markup_text(cell(r, "td"))))
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))


def infobox_values(pages: DataFrame, html_col: str = "html", header_word: str = "capacity", out_col: str = "capacity") -> DataFrame:
    """P18 as a column of a page table."""
    return pages.withColumn(out_col, infobox_number(F.col(html_col), header_word).cast("int"))

"""Data-quality gates and reports.

Parquet enforces no constraint, so every declared constraint is an expectation
job run *before* anything is written.  Scale rules followed here:
* checks on one table are folded into one aggregate pass and unpivoted, so
  the fact is scanned once for all NOT NULL / CHECK rules;
* foreign keys that point at the same dimension share one anti join (the id
  columns are stacked as (fk_column, id) rows first);
* duplicate keys are a grouped count (partial aggregation, no group gathered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.numeric import count_if
from crease.session import scratch_path

# --- fixed values (must equal the reference's) ---
# Expected share of deliveries per phase (warn outside).
PHASE_RANGES = {"powerplay": (0.25, 0.40), "middle": (0.35, 0.55), "death": (0.15, 0.30)}
MATCH_PHASES = ("powerplay", "middle", "death")
GENDERS = ("male", "female")
# --- end fixed values ---


def non_null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Populated (non-null) count per column in one pass; flag columns with none."""
    agg = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in cols])
    out = agg.unpivot(["total"], cols, "col_name", "populated")
    return out.select("col_name", "populated", "total", (F.col("populated") == 0).alias("zero_populated"))


def value_distribution(df: DataFrame, group_col: str, value_col: str, bound: int) -> DataFrame:
    """Frequency per raw value of ``group_col``, with the max of ``value_col`` and rows above ``bound``."""
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(value_col).alias(f"max_{value_col.split('_')[0]}"),
        count_if(F.col(value_col) > bound).alias("above_bound"),
    )


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """Row count of every table, compared with an expectation when given."""
    parts = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table_name"), "actual")
        parts = part if parts is None else parts.unionByName(part)
    exp = expected or {}
    exp_col = F.lit(None).cast("bigint")
    for name, n in exp.items():
        exp_col = F.when(F.col("table_name") == name, F.lit(n).cast("bigint")).otherwise(exp_col)
    return parts.select(
        "table_name", "actual", exp_col.alias("expected"),
        F.coalesce(F.col("actual") == exp_col, F.lit(True)).alias("passed"),
    )


def stacked_ids(fact: DataFrame, fk_cols: list[str]) -> DataFrame:
    """(fk_column, id) rows for several id columns of one row set (one pass)."""
    arr = F.array(*[F.struct(F.lit(c).alias("fk_column"), F.col(c).cast("string").alias("id")) for c in fk_cols])
    return fact.select(F.explode(arr).alias("x")).select("x.fk_column", "x.id")


def fk_counts(fact: DataFrame, refs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Orphan and NULL counts for many foreign keys in one pass over ``fact``.

    ``refs`` maps an id column to (dimension, key column).  Ids of all columns
    are stacked and counted per (column, id) (partial aggregation: a hot id
    or a mass of NULLs becomes one row per task before any shuffle).  The
    distinct non-null ids, tagged with their column, are checked by one anti
    join against the union of the tagged dimension keys.
    Returns (fk_column, orphan_rows, null_rows); NULL ids are counted in
    ``orphan_rows`` too, as LEFT JOIN ... IS NULL does.
    """
    cols = list(refs)
    counted = stacked_ids(fact, cols).groupBy("fk_column", "id").agg(F.count(F.lit(1)).alias("n"))
    keys = None
    for c, (dim, key) in refs.items():
        k = dim.select(F.lit(c).alias("fk_column"), F.col(key).cast("string").alias("id"))
        keys = k if keys is None else keys.unionByName(k)
    present = counted.where(F.col("id").isNotNull())
    # both sides are dealt by these columns already; a broadcast would pass every match id through the driver
    missing = present.join(keys.distinct().hint("merge"), ["fk_column", "id"], "left_anti")
    nulls = counted.where(F.col("id").isNull())
    per = missing.select("fk_column", "n", F.lit(0).cast("bigint").alias("z")).unionByName(
        nulls.select("fk_column", "n", F.col("n").alias("z"))
    )
    counts = per.groupBy("fk_column").agg(F.sum("n").alias("orphan_rows"), F.sum("z").alias("null_rows"))
    all_cols = fact.sparkSession.createDataFrame([(c,) for c in cols], "fk_column string")
    return all_cols.join(counts, "fk_column", "left").select(
        "fk_column",
        F.coalesce("orphan_rows", F.lit(0)).cast("bigint").alias("orphan_rows"),
        F.coalesce("null_rows", F.lit(0)).cast("bigint").alias("null_rows"),
    )


def orphans(fact: DataFrame, fk_cols: list[str], dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose id has no dimension row, per id column (NULL ids count as
    orphans, as LEFT JOIN ... IS NULL does); see ``fk_counts``."""
    return fk_counts(fact, {c: (dim, dim_key) for c in fk_cols}).select("fk_column", "orphan_rows")


def orphan_ids(fact: DataFrame, fk_cols: list[str], dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct missing ids per column with their count and one sample id."""
    ids = stacked_ids(fact, fk_cols).where(F.col("id").isNotNull()).distinct()
    keys = dim.select(F.col(dim_key).cast("string").alias("id"))
    missing = ids.join(keys, "id", "left_anti")
    return missing.groupBy("fk_column").agg(F.count(F.lit(1)).alias("missing_ids"), F.min("id").alias("sample_id"))


SAMPLES = 5


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table below the shared folder, for several readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def orphan_samples(
    fact: DataFrame, refs: dict[str, tuple[DataFrame, str]], row: dict[str, tuple[str, ...]], samples: int = SAMPLES
) -> DataFrame:
    """Per id column its distinct ids, those without a dimension row and their rows, samples and an example.

    ``refs`` maps an id column to (dimension, key column); ``row`` names the columns shown
    of an example row, the key's first.  One pass over ``fact``: ids are counted per
    (column, id) before the shuffle, with their smallest row.  The ``samples`` smallest
    missing ids of a column are taken by a ranked window that drops the others in each
    task before its shuffle; the example is the smallest missing id's smallest row."""
    shown = {c: F.array(*[F.col(x).cast("string") for x in row[c]]) for c in refs}
    each = [F.struct(F.lit(c).alias("fk_column"), F.col(c).cast("string").alias("id"), shown[c].alias("row")) for c in refs]
    ids = fact.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("id IS NOT NULL")
    counted = ids.groupBy("fk_column", "id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    keys = None
    for c, (dim, key) in refs.items():
        k = dim.select(F.lit(c).alias("fk_column"), F.col(key).cast("string").alias("id")).distinct().withColumn("known", F.lit(True))
        keys = k if keys is None else keys.unionByName(k)
    counted = _written(counted.join(keys, ["fk_column", "id"], "left").withColumn("known", F.col("known").isNotNull()), "orphan-ids")
    totals = counted.groupBy("fk_column").agg(
        F.count(F.lit(1)).alias("unique_ids"),
        count_if(~F.col("known")).cast("bigint").alias("missing_ids"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).cast("bigint").alias("missing_rows"),
    )
    rank = F.row_number().over(Window.partitionBy("fk_column").orderBy("id"))
    first = counted.where(~F.col("known")).withColumn("rank", rank).where(F.col("rank") <= samples)
    taken = first.groupBy("fk_column").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample_ids"),
        F.min(F.when(F.col("rank") == 1, F.array_join("row", ","))).alias("example_row"),
    )
    names = fact.sparkSession.createDataFrame([(c,) for c in refs], "fk_column string")
    out = names.join(totals, "fk_column", "left").join(taken, "fk_column", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("unique_ids", "missing_ids", "missing_rows")]
    return out.select("fk_column", *zero, "sample_ids", "example_row")


def rows_above(df: DataFrame, value_col: str, bound: int, shown: list[str]) -> DataFrame:
    """Every row whose ``value_col`` is above ``bound``, as its ``shown`` columns (a filter, pushed to the scan)."""
    return df.where(F.col(value_col) > bound).select(*shown, value_col)


def phase_share(fact: DataFrame, ranges: dict[str, tuple[float, float]] = PHASE_RANGES) -> DataFrame:
    """Share of rows per phase against its expected range; a missing phase counts 0."""
    spark = fact.sparkSession
    rng = spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in ranges.items()], "match_phase string, min_share double, max_share double")
    counts = fact.groupBy("match_phase").agg(F.count(F.lit(1)).alias("n"))
    # one fact pass: the total is the sum of the per-phase counts (one row per phase
    # value, so this window sees a handful of rows)
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
    total = counts.select("total").distinct()
    out = F.broadcast(rng).join(counts.drop("total"), "match_phase", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    out = out.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    return out.where(F.col("total") > 0).select(
        "match_phase", "n", "total", share.alias("share"), "min_share", "max_share",
        ((share >= F.col("min_share")) & (share <= F.col("max_share"))).alias("in_range"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q4: number of key groups that occur more than once, and the extra rows."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    return g.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("extra_rows"))


def _rule_rows(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One aggregate pass: violations per rule -> (table_name, constraint_name, violations)."""
    names = [n for n, _ in rules]
    agg = df.agg(*[count_if(cond).alias(n) for n, cond in rules])
    return agg.unpivot([], names, "constraint_name", "violations").select(
        F.lit(table).alias("table_name"), "constraint_name", F.col("violations").cast("bigint").alias("violations")
    )


FACT_NOT_NULL = [
    "match_id", "innings_number", "delivery_sequence", "over_number", "ball_in_over", "match_phase",
    "batting_team", "bowling_team", "batter_name", "batter_id", "bowler_name", "bowler_id",
    "non_striker_name", "non_striker_id", "batter_runs", "extras_runs", "total_runs",
    "is_legal_delivery", "is_dot_ball", "is_boundary_four", "is_boundary_six", "is_wicket", "is_bowler_wicket",
]


def fact_ball_rules() -> list[tuple[str, Column]]:
    """Q6: NOT NULL and CHECK constraints of the ball fact."""
    rules = [(f"not_null_{c}", F.col(c).isNull()) for c in FACT_NOT_NULL]
    rules.append(("check_innings_ge_1", F.coalesce(F.col("innings_number") < 1, F.lit(False))))
    rules.append(("check_match_phase", F.coalesce(~F.col("match_phase").isin(*MATCH_PHASES), F.lit(False))))
    return rules


# --- fixed values (must equal the reference's) ---
# Keys and NOT NULL columns of the dimensions, and which of their columns are a gender.
DIM_KEYS = {
    "dim_player": ["player_id"],
    "dim_team": ["team_id"],
    "dim_venue": ["venue_id"],
    "dim_season": ["season_year", "gender"],
    "dim_match": ["match_id"],
}
DIM_NOT_NULL = {
    "dim_player": ["player_id", "player_name", "gender"],
    "dim_team": ["team_id", "team_name"],
    "dim_venue": ["venue_id", "venue_name"],
    "dim_season": ["season_year", "season_label", "gender", "total_matches"],
    "dim_match": ["match_id", "season_year", "tournament", "gender", "venue_id", "team1_id", "team2_id"],
}
DIM_GENDER_CHECKS = ["dim_player", "dim_season"]
# --- end fixed values ---


FACT_KEY = ["match_id", "innings_number", "delivery_sequence"]


def table_rules(table: str) -> list[tuple[str, Column]]:
    """Q6: NOT NULL and CHECK rules of a table of the star: (name, condition of a violation)."""
    if table == "fact_ball":
        return fact_ball_rules()
    rules = [(f"not_null_{c}", F.col(c).isNull()) for c in DIM_NOT_NULL.get(table, [])]
    if table in DIM_GENDER_CHECKS:
        rules.append(("check_gender", F.coalesce(~F.col("gender").isin(*GENDERS), F.lit(True))))
    return rules


def observed_metrics(table: str) -> list[Column]:
    """What a write of the table observes of its rows, without a scan of its own.

    ``rows``, the violations of each rule, and for the fact the rows of each phase."""
    metrics = [F.count(F.lit(1)).alias("rows"), *[count_if(cond).alias(name) for name, cond in table_rules(table)]]
    if table == "fact_ball":
        metrics += [count_if(F.col("match_phase") == p).alias(f"phase_{p}") for p in MATCH_PHASES]
    return metrics


def _rules_seen(spark, table: str, seen: dict[str, int]) -> DataFrame:
    rows = [(table, name, int(seen[name])) for name, _ in table_rules(table)]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, violations bigint")


def primary_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q4 for many tables in one keyed aggregate: (table_name, primary_key, rows beyond the first of a key)."""
    tagged = None
    for name, (df, keys) in tables.items():
        part = df.select(F.lit(name).alias("table_name"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key"))
        tagged = part if tagged is None else tagged.unionByName(part)
    extra = tagged.groupBy("table_name", "key").agg((F.count(F.lit(1)) - 1).alias("extra"))
    found = extra.groupBy("table_name").agg(F.sum("extra").alias("extra"))
    names = tagged.sparkSession.createDataFrame([(n,) for n in tables], "table_name string")
    return names.join(found, "table_name", "left").select(
        "table_name", F.lit("primary_key").alias("constraint_name"), F.coalesce("extra", F.lit(0)).cast("bigint").alias("violations")
    )


def dimension_constraints(tables: dict[str, DataFrame], observed: dict[str, dict] | None = None) -> DataFrame:
    """Q6 for the dimensions: NOT NULL, genders, and the match table's references.

    A NULL reference breaks a NOT NULL rule or is allowed; it never counts as an orphan."""
    parts = []
    for name in DIM_NOT_NULL:
        if observed and name in observed:
            parts.append(_rules_seen(tables[name].sparkSession, name, observed[name]))
        else:
            parts.append(_rule_rows(tables[name], name, table_rules(name)))
    team, refs = (tables["dim_team"], "team_id"), {}
    refs["venue_id"] = (tables["dim_venue"], "venue_id")
    refs |= {c: team for c in ("team1_id", "team2_id", "toss_winner_team_id", "winner_team_id")}
    refs["player_of_match_id"] = (tables["dim_player"], "player_id")
    fk = fk_counts(tables["dim_match"], refs)
    parts.append(fk.select(
        F.lit("dim_match").alias("table_name"), F.concat(F.lit("fk_"), F.col("fk_column")).alias("constraint_name"),
        (F.col("orphan_rows") - F.col("null_rows")).cast("bigint").alias("violations"),
    ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constraint_report(star, player_dim: DataFrame | None = None, observed: dict[str, dict] | None = None) -> DataFrame:
    """Q6: declared constraints (PK, NOT NULL, CHECK, FK) of all tables as one report.

    (table_name, constraint_name, violations, passed); nothing may be published
    while any row has passed = false.  Rules whose violations a write ``observed``
    (``observed_metrics``) cost no scan; the keys of all tables are one aggregate,
    and the references of a table another.
    """
    fact, dm, dp = star.fact_ball, star.dim_match, player_dim if player_dim is not None else star.dim_player
    tables = {"dim_player": dp, "dim_match": dm} | {n: getattr(star, n) for n in ("dim_team", "dim_venue", "dim_season")}
    seen = (observed or {}).get("fact_ball")
    keyed = {"fact_ball": (fact, FACT_KEY)} | {n: (tables[n], k) for n, k in DIM_KEYS.items()}
    parts = [
        _rules_seen(fact.sparkSession, "fact_ball", seen) if seen else _rule_rows(fact, "fact_ball", fact_ball_rules()),
        primary_keys(keyed),
        dimension_constraints(tables, observed),
    ]
    # every FK of the fact in one pass; NULL optional ids (player out, fielder) are allowed
    optional = ("player_out_id", "fielder_id")
    refs = {c: (dp, "player_id") for c in ("batter_id", "bowler_id", "non_striker_id", *optional)}
    refs["match_id"] = (dm, "match_id")
    fk = fk_counts(fact, refs)
    viol = F.when(F.col("fk_column").isin(*optional), F.col("orphan_rows") - F.col("null_rows")).otherwise(F.col("orphan_rows"))
    parts.append(fk.select(
        F.lit("fact_ball").alias("table_name"), F.concat(F.lit("fk_"), F.col("fk_column")).alias("constraint_name"),
        viol.cast("bigint").alias("violations"),
    ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violations") == 0)


def assert_passed(report: DataFrame, what: str = "quality report") -> None:
    """Fail closed: raise if any failing row exists; the message names every one.

    A report has one row per rule, so its size doesn't depend on the data."""
    bad = report.where(~F.coalesce(F.col("passed"), F.lit(False))).collect()
    if bad:
        raise AssertionError(f"{what}: {len(bad)} rules failed: " + "; ".join(str(r.asDict()) for r in bad))


def fact_ball_rule_sql() -> list[tuple[str, str]]:
    """SQL text of ``fact_ball_rules`` (same names, same order), for oracles and docs."""
    rules = [(f"not_null_{c}", f"{c} IS NULL") for c in FACT_NOT_NULL]
    rules.append(("check_innings_ge_1", "COALESCE(innings_number < 1, FALSE)"))
    phases = ", ".join(f"'{p}'" for p in MATCH_PHASES)
    rules.append(("check_match_phase", f"COALESCE(match_phase NOT IN ({phases}), FALSE)"))
    return rules


def run_all_checks(
    fact: DataFrame,
    tables: dict[str, DataFrame],
    dim_player: DataFrame,
    dim_match: DataFrame,
    expected: dict[str, int] | None = None,
    player_fks: tuple[str, ...] = ("batter_id", "bowler_id", "non_striker_id"),
) -> DataFrame:
    """Q5: all gates in the reference's order, as one report
    (check_name, severity, observed, passed).  'fail' rows gate the write,
    'warn' rows are reported only."""
    rc = row_counts(tables, expected).select(
        F.concat(F.lit("row_count:"), "table_name").alias("check_name"), F.lit("fail").alias("severity"),
        F.col("actual").cast("double").alias("observed"), "passed",
    )
    refs = {c: (dim_player, "player_id") for c in player_fks}
    refs["match_id"] = (dim_match, "match_id")
    orph = fk_counts(fact, refs)
    orph = orph.select(
        F.concat(F.lit("orphans:"), "fk_column").alias("check_name"), F.lit("fail").alias("severity"),
        F.col("orphan_rows").cast("double").alias("observed"), (F.col("orphan_rows") == 0).alias("passed"),
    )
    ph = phase_share(fact).select(
        F.concat(F.lit("phase_share:"), "match_phase").alias("check_name"), F.lit("warn").alias("severity"),
        F.col("share").alias("observed"), F.col("in_range").alias("passed"),
    )
    dup = duplicate_keys(fact, ["match_id", "innings_number", "delivery_sequence"]).select(
        F.lit("duplicates:fact_ball").alias("check_name"), F.lit("fail").alias("severity"),
        F.col("duplicate_keys").cast("double").alias("observed"), (F.col("duplicate_keys") == 0).alias("passed"),
    )
    return rc.unionByName(orph).unionByName(ph).unionByName(dup)


def observed_checks(spark, report: list, observed: dict[str, dict], actual: dict[str, int]) -> DataFrame:
    """Q5 without a further pass: (check_name, severity, observed, passed) in ``run_all_checks``' order.

    ``report``: the rows of ``constraint_report`` over the written tables; ``observed``: what
    their writes saw, whose row counts are the expectation; ``actual``: rows found in the files."""
    violations = {(r["table_name"], r["constraint_name"]): r["violations"] for r in report}
    rows = [(f"row_count:{t}", "fail", float(n), n == observed[t]["rows"]) for t, n in actual.items()]
    for c in ("batter_id", "bowler_id", "non_striker_id", "match_id"):
        n = violations["fact_ball", f"fk_{c}"]
        rows.append((f"orphans:{c}", "fail", float(n), n == 0))
    fact = observed["fact_ball"]
    for phase, (low, high) in PHASE_RANGES.items() if fact["rows"] else ():
        share = fact[f"phase_{phase}"] / fact["rows"]
        rows.append((f"phase_share:{phase}", "warn", share, low <= share <= high))
    n = violations["fact_ball", "primary_key"]
    rows.append(("duplicates:fact_ball", "fail", float(n), n == 0))
    return spark.createDataFrame(rows, "check_name string, severity string, observed double, passed boolean")

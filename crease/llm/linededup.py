"""Operator 5: line dedup by overlapping three-line windows, in DataFrame operations alone.

Every three consecutive lines of a document are one window, known by two
64-bit hashes.  Of a window that occurs again anywhere, the occurrence in the
smallest (document, position) stays; all later ones are removed, and a line
goes when at least one removed window covers it.  Each distinct line survives
at its first place, since whatever removes a line lies before it.

Only hashes and positions are shuffled to find the repeats: counts and firsts
are aggregated before the shuffle, so a window in a third of all documents is
one row per task there.  Its occurrences then meet the one row of its first
place in a join that Spark may split where it is skewed.  The removed positions
of a document, never more than its lines, join the text once.

Defined cases.  Lines end at line feeds; an empty text is one empty line.
Documents of fewer than ``window`` lines and null texts stay as they are.  Rows
equal in id and text are one document and get the same result.  Null ids come
before others.  A document of which all lines go keeps a row with an empty
text.  Empty table: no rows.  Only the named columns are read, so extra columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import only


def line_windows(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _th, _pos, _h1, _h2) for each ``window`` consecutive lines."""
    shifted = [F.col("_lines")] + [F.expr(f"slice(_lines, {k + 1}, size(_lines))") for k in range(1, window)]
    rows = (
        docs.withColumn("_lines", F.split("_text", "\n"))
        .where(F.size("_lines") >= window)
        .select("_id", "_th", F.posexplode(F.arrays_zip(*[c.alias(f"l{k}") for k, c in enumerate(shifted)])))
        .toDF("_id", "_th", "_pos", "_w")
        .where(F.col(f"_w.l{window - 1}").isNotNull())
    )
    lines = [F.col(f"_w.l{k}") for k in range(window)]
    return rows.select(
        "_id", "_th", "_pos", F.xxhash64(*lines).alias("_h1"), F.xxhash64(F.lit(window), *lines[::-1]).alias("_h2")
    )


def dedup_lines(df: DataFrame, doc_id: str, text: str, keep: Sequence[str] = (), window: int = 3) -> DataFrame:
    """``doc_id``, ``text`` without repeated windows, columns ``keep``, ``n_lines`` and ``n_removed`` of every row."""
    kept_names = [f"_k{i}" for i in range(len(keep))]
    docs = only(df, doc_id, text, *keep).toDF("_id", "_text", *kept_names).withColumn("_th", F.xxhash64("_text"))
    found = line_windows(docs, window)
    place = F.struct("_id", "_th", "_pos")
    first = (
        found.groupBy("_h1", "_h2")
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    later = found.join(first, ["_h1", "_h2"]).where(~place.eqNullSafe(F.col("_first")))
    gone = later.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_starts"))
    gone = gone.select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), "_starts")

    joined = docs.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    lined = joined.withColumn("_lines", F.split("_text", "\n"))
    covered = reduce(
        lambda a, k: F.concat(a, F.transform("_starts", lambda p: p + F.lit(k))), range(1, window), F.col("_starts")
    )
    kept = lined.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered))
    rebuilt = F.concat_ws("\n", F.transform("_kept", lambda p: F.get("_lines", p)))
    return kept.select(
        F.col("_id").alias(doc_id),
        F.when(F.col("_starts").isNull(), F.col("_text")).otherwise(rebuilt).alias(text),
        *[F.col(k).alias(name) for k, name in zip(kept_names, keep, strict=True)],
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_starts").isNull(), F.lit(0))
        .otherwise(F.size("_lines") - F.size("_kept"))
        .cast("long")
        .alias("n_removed"),
    )


ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS occurrence
        FROM windows WHERE c IS NOT NULL)
    WHERE occurrence > 1
), covered AS (
    SELECT DISTINCT doc_id, pos + step AS pos FROM later CROSS JOIN (VALUES (0), (1), (2)) s(step)
), judged AS (
    SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone
    FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_removed
FROM judged GROUP BY doc_id
UNION ALL
SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

"""Registry of named queries: Spark plan + DuckDB oracle SQL per key.

``QUERIES[key] = Query(run, oracle)`` where ``run(spark, sf_dir) -> DataFrame``
and ``oracle`` is DuckDB SQL over the driver's pre-registered tables (or None
for keys with no practical SQL oracle).  Keys, inputs and parameters follow
FIXTURES.md section 3.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, "Query"] = {}


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def register(key: str, oracle: str | None):
    def deco(fn):
        QUERIES[key] = Query(fn, oracle)
        return fn

    return deco


def hu(x: str, digits: int) -> str:
    """SQL of the shared half-up rounding rule (see functions.numeric.round_half_up)."""
    scale = f"{float(10 ** digits)!r}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def sql_ratio(num: str, den: str, scale: float) -> str:
    return f"(CAST({num} AS DOUBLE) * {scale!r} / NULLIF(CAST({den} AS DOUBLE), 0))"


def values_sql(rows: list[tuple], cols: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({cols}))"


# importing the query modules fills QUERIES
from crease.plans import q_derived, q_dims, q_documents, q_enrich, q_ingest, q_quality, q_reports, q_sinks  # noqa: E402,F401

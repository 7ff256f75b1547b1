"""Numeric helpers shared by reports and derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crease.functions.text import col_of


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero on a double.

    Spark's ``round`` and DuckDB's ``ROUND`` disagree on doubles such as 1.005;
    ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` gives the same bits in both.
    """
    x = col_of(c).cast("double")
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``num * scale / den`` as double, null when ``den`` is 0 or null."""
    return F.try_divide(col_of(num).cast("double") * F.lit(float(scale)), col_of(den).cast("double"))


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: 0 (not null) on an empty group with rows."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")

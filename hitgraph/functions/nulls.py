"""Arithmetic that keeps the study's conventions where ANSI SQL would raise or give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def safe_ln(x: Column) -> Column:
    """ln with ln(0) = -inf; NULL below 0."""
    return F.when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def safe_log10(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).otherwise(F.log10(x))


def safe_div(a: Column, b: Column) -> Column:
    """Double division: x/0 is +-inf, 0/0 NULL."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def q6(x: Column) -> Column:
    """Six decimals, half up, alike in every engine (round is not)."""
    return F.floor(x * 1e6 + 0.5) / 1e6

"""Grouping by quantiles and histograms whose number of bins follows from the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import plotdata, ranks
from .plotdata import finite


def percentiles(df: DataFrame, x: str, qs: list[float]) -> list[float]:
    """Type-6 percentiles of a whole column, read off its ranks: one range shuffle, and a row of sums to the driver."""
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError("percentiles lie from 0 to 1")
    r = ranks.ranked(df.where(finite(x)).select(F.lit(0).alias("_g"), F.col(x).cast("double").alias("_v")), ["_g"], "_v")
    n = F.col("group_size")
    sums = []
    for q in qs:
        place = F.lit(float(q)) * (n + 1.0)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), n)
        high = F.least(low + 1, n)
        at = lambda p: F.max(F.when((F.col("rank_min") <= p) & (p <= F.col("rank_max")), F.col("_v")))
        sums += [at(low), at(high), F.max(F.when((place < 1) | (place >= n), 0.0).otherwise(place - F.floor(place)))]
    row = r.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()
    if not qs or row["s0"] is None:
        return [math.nan] * len(qs)
    return [row[f"s{3 * i}"] + row[f"s{3 * i + 2}"] * (row[f"s{3 * i + 1}"] - row[f"s{3 * i}"]) for i in range(len(qs))]


def interval(x: Column, limits: list[float]) -> Column:
    """The number i with limits[i] <= x < limits[i + 1], NULL outside: a binary search written out as CASE, so it is compiled."""
    last = len(limits)

    def search(lo: int, hi: int) -> Column:
        """How many limits are at most x, known to be from lo to hi."""
        if lo == hi:
            return F.lit(lo - 1 if 0 < lo < last else None).cast("int")
        mid = (lo + hi) // 2
        return F.when(x < limits[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(x.isNotNull() & ~F.isnan(x), search(0, last))


def quantile_bins(df: DataFrame, binning: str, qs: list[float], of: str | None = None) -> DataFrame:
    """df with bin, lower, upper: bins from the least value to the first percentile, from there to the next, and so on.

    Percentiles (ascending) are those of `of`, by default of the binning column itself.  Bins are half-open, so at
    a last percentile of 1 the largest value is in none; rows in no bin drop, and so do NULL, NaN and infinite ones.
    """
    of = of or binning
    first = df.where(finite(of)).agg(F.min(F.col(of).cast("double")).alias("lo")).first()["lo"]
    limits = [first, *percentiles(df, of, qs)] if first is not None else [0.0, 0.0]
    table = F.array(*[F.lit(float(v)) for v in limits])
    binned = df.withColumn("bin", F.when(finite(binning), interval(F.col(binning).cast("double"), limits))).where("bin is not null")
    return binned.withColumns({"lower": table[F.col("bin")], "upper": table[F.col("bin") + 1]})


def binned_boxes(df: DataFrame, x: str, binning: str, qs: list[float]) -> DataFrame:
    """bin, lower, upper and the five numbers of x in each bin that has rows."""
    binned = quantile_bins(df.select(x, binning) if x != binning else df.select(x), binning, qs)
    return plotdata.box(binned, ["bin", "lower", "upper"], x)


def histogram_breaks(df: DataFrame, x: str, breaks: int = 0, least: int = 0) -> DataFrame:
    """bin, n, lower of a histogram in so many steps from the least to the largest value; 0: floor(sqrt(2 rows)) + 1.

    Half-open bins, the last one closed; one step of 1 if all values are equal.  Bins of fewer than `least` rows go.
    All rows count for the rule, finite ones for the bins.
    """
    s = df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(finite(x), F.col(x).cast("double"))).alias("lo"), F.max(F.when(finite(x), F.col(x).cast("double"))).alias("hi")).first()
    if s["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin long, n long, lower double")
    count = breaks if breaks > 0 else int(math.sqrt(2.0 * s["rows"])) + 1
    step, count = ((s["hi"] - s["lo"]) / count, count) if s["hi"] > s["lo"] else (1.0, 1)
    place = F.least(F.floor((F.col(x).cast("double") - s["lo"]) / step), F.lit(count - 1)).cast("long")
    out = df.where(finite(x)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return out.withColumn("lower", s["lo"] + F.col("bin") * step)

"""Tables behind plots: histograms, densities, boxes, hexagons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def finite(x: str):
    v = F.col(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def histogram(df: DataFrame, x: str, low: float, step: float, bins: int) -> DataFrame:
    """bin, lower, count: half-open bins, the last closed; finite values in range only.  Arithmetic, not a range join."""
    top = low + step * bins
    ok = df.where(finite(x) & F.col(x).between(low, top))
    b = F.least(F.floor((F.col(x) - low) / step), F.lit(bins - 1)).cast("long")
    return ok.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("lower", low + F.col("bin") * step)


def box(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Five numbers by group, percentiles of type 6: place p(n + 1) among the sorted values, interpolated and clamped.

    Values are counted and ranked by one range shuffle and picked by place, so no group is gathered.
    """
    r = ranks.ranked(df.where(finite(x)).select(*group, F.col(x).cast("double").alias("_v")).withColumn("_g", F.lit(0)), [*group, "_g"], "_v")
    n = F.col("group_size")

    def at(place):
        """The value in this place: aggregate."""
        return F.max(F.when((F.col("rank_min") <= place) & (place < F.col("rank_min") + F.col("ties")), F.col("_v")))

    def percentile(p: float):
        place = p * (n + 1)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), n)
        return at(low), at(F.least(low + 1, n)), F.max(F.when((place <= 1) | (place >= n), 0.0).otherwise(place - F.floor(place)))

    quartiles = [(name, percentile(p)) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    s = r.groupBy(*group).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), *[c.alias(f"_{name}{i}") for name, q in quartiles for i, c in enumerate(q)])
    return s.select(*group, "lo", *[(F.col(f"_{name}0") + F.col(f"_{name}2") * (F.col(f"_{name}1") - F.col(f"_{name}0"))).alias(name) for name, _ in quartiles], "hi")


def kde(df: DataFrame, x: str, points: int = 51, bandwidth: float | None = None) -> DataFrame:
    """Gaussian density on an even grid; the default bandwidth is 1.06 * sd * points^-0.2."""
    b = df.where(finite(x)).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    if b["lo"] is None:
        return df.sparkSession.createDataFrame([], "at double, density double")
    h = bandwidth or 1.06 * (b["sd"] or 1.0) * points**-0.2
    step = (b["hi"] - b["lo"]) / (points - 1)
    # few distinct sums: each row adds to every grid point, aggregated before the shuffle
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(b["lo"]) + i * step)
    rows = df.where(finite(x)).select(F.col(x).cast("double").alias("v"), F.explode(grid).alias("at"))
    z = (F.col("at") - F.col("v")) / h
    return rows.groupBy("at").agg((F.avg(F.exp(-0.5 * z * z)) / (h * 2.5066282746310002)).alias("density"))


def hexbin(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """cx, cy, n: the nearest centre on two offset lattices."""
    def near(ox: float, oy: float):
        i, j = F.floor((F.col(x) - ox * width) / width + 0.5), F.floor((F.col(y) - oy * height) / height + 0.5)
        cx, cy = (i + ox) * width, (j + oy) * height
        dx, dy = (F.col(x) - cx) / width, (F.col(y) - cy) / height
        return F.struct((dx * dx + 3 * dy * dy).alias("d"), cx.alias("cx"), cy.alias("cy"))

    best = F.array_min(F.array(near(0.0, 0.0), near(0.5, 0.5)))
    return df.where(finite(x) & finite(y)).groupBy(best["cx"].alias("cx"), best["cy"].alias("cy")).agg(F.count(F.lit(1)).alias("n"))

"""Rows for panels and networks: highlights, style rules, labels, areas, bounds over layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def highlight(df: DataFrame, columns: list[str], low: float | None, high: float | None) -> DataFrame:
    """Adds <column>_mark: low below the lower cut-off, high above the upper one, else NULL."""
    mark = lambda c: F.when(F.col(c) < low, "low").when(F.col(c) > high, "high") if low is not None and high is not None else F.when(F.col(c) < low, "low") if low is not None else F.when(F.col(c) > high, "high")
    return df.withColumns({f"{c}_mark": mark(c) for c in columns})


def style(df: DataFrame, rules: list[tuple[str | None, object, dict[str, object]]]) -> DataFrame:
    """Adds a column for each property: that of the last rule whose attribute has the value; a rule on None holds for all."""
    names = list(dict.fromkeys(p for _, _, s in rules for p in s))

    def of(name: str) -> Column:
        cases = [(F.lit(True) if a is None else F.col(a) == v, s[name]) for a, v, s in reversed(rules) if name in s]
        return F.coalesce(*[F.when(c, F.lit(str(v))) for c, v in cases])

    return df.withColumns({n.replace("-", "_"): of(n) for n in names})


def neglog(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def rank_panel(df: DataFrame, by: list[str], key: str, fdr: str, labels: int = 10, cut: float = 0.05) -> DataFrame:
    """by, key, rank by fdr (ties by key), neglog, hit, and a label's height for the first ones: 4.5 - (rank - 1) * 0.4."""
    keyed = df.select(*by, key, fdr, F.struct(F.col(fdr), F.col(key)).alias("_o"))
    r = ranks.with_rank(keyed, by, "_o")
    return r.select(*by, key, "rank", neglog(F.col(fdr)).alias("neglog"), (F.col(fdr) < cut).alias("hit"), F.when(F.col("rank") <= labels, 4.5 - (F.col("rank") - 1) * 0.4).alias("label_y"))


def dots(df: DataFrame, keys: list[str], p: str, cap: float = 10.0) -> DataFrame:
    """keys, size and alpha of a dot by -log10 p: size up to the cap, alpha its share of the cap."""
    size = F.least(neglog(F.col(p)), F.lit(cap))
    return df.select(*keys, size.alias("size"), (size / cap).alias("alpha"))


def network_nodes(nodes: DataFrame, key: str, count: str, named: list[str], more_than: int = 3) -> DataFrame:
    """Nodes with size = sqrt(count), colour = count, and a label if the count is over a limit or the node is named."""
    return nodes.withColumns({"size": F.sqrt(F.col(count).cast("double")), "colour": F.col(count), "label": F.when((F.col(count) > more_than) | F.col(key).cast("string").isin(named), F.col(key).cast("string")).otherwise("")})


def area(df: DataFrame, by: list[str], order: str, x: str, y: str, base: str | float = 0.0) -> DataFrame:
    """by, x0, top0, low0, x1, top1, low1: the piece between each point and the one before; base: the lower edge."""
    low = F.col(base) if isinstance(base, str) else F.lit(float(base))
    w = Window.partitionBy(*by).orderBy(order)
    r = df.select(*by, F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("top0"), F.lag(low).over(w).alias("low0"), F.col(x).alias("x1"), F.col(y).alias("top1"), low.alias("low1"))
    return r.where("x0 is not null")


def layer_bounds(layers: list[tuple[DataFrame, list[str]]], names: list[str]) -> DataFrame:
    """One row: the least and the largest of each axis over all layers; axes by their place in each layer's columns."""
    parts = [df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{k}") for n, c in zip(names, cols) for k, f in (("lo", F.min), ("hi", F.max))]) for df, cols in layers]
    every = reduce(DataFrame.unionByName, parts)  # a row a layer
    return every.agg(*[f(f"{n}_{k}").alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])


def bezier(df: DataFrame, keys: list[str], points: list[tuple[str, str]], steps: int = 8) -> DataFrame:
    """keys, t, x, y: places on the cubic curve through four points, steps + 1 for each row."""
    t = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_t")
    d = df.select(*keys, *[F.col(c) for p in points for c in p], t).withColumn("t", F.col("_t") / F.lit(float(steps)))
    one = 1 - F.col("t")
    weights = [one * one * one, 3 * one * one * F.col("t"), 3 * one * F.col("t") * F.col("t"), F.col("t") * F.col("t") * F.col("t")]
    at = lambda axis: reduce(lambda a, b: a + b, [w * F.col(p[axis]) for w, p in zip(weights, points)])
    return d.select(*keys, "t", at(0).alias("x"), at(1).alias("y"))


def project(df: DataFrame, keys: list[str], xyz: tuple[str, str, str], rows: list[list[float]]) -> DataFrame:
    """keys, x, y, depth: points under a camera's 3 x 4 matrix, divided by depth where that is positive, else NULL."""
    line = lambda r: r[0] * F.col(xyz[0]) + r[1] * F.col(xyz[1]) + r[2] * F.col(xyz[2]) + r[3]
    depth = line(rows[2])
    return df.select(*keys, F.when(depth > 0, line(rows[0]) / depth).alias("x"), F.when(depth > 0, line(rows[1]) / depth).alias("y"), depth.alias("depth"))

"""Frames by key: lookups, joins and concatenations of columns, reshaping, scaling, counts and histograms.

Nothing here gathers a group in one task: what a row needs of its whole column is one row beside it, orders come from
range shuffles, and joins are left to the planner, which broadcasts a side by its size only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .plotdata import finite


def _beside(df: DataFrame, **sums: Column) -> DataFrame:
    """df with aggregates of the whole of it: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in sums.items()])))


def _on(df: DataFrame, key: str, other: DataFrame, how: str, other_key: str | None = None) -> DataFrame:
    """df joined with other by one key; other's key goes, and NULL meets nothing."""
    right = other.withColumnRenamed(other_key or key, "_right")
    out = df.alias("_left").join(right, F.col(f"_left.`{key}`") == F.col("_right"), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_right")


# columns and labels


def melt(df: DataFrame, key: list[str], columns: dict[str, str], var: str = "what", value: str = "v") -> DataFrame:
    """A row for each key and column: key, the column's new name, its value as double (NULL stays)."""
    wide = df.select(*key, *[F.col(c).cast("double").alias(n) for n, c in columns.items()])
    return wide.unpivot(key, list(columns), var, value)


def pivot(df: DataFrame, row: str, col: str, value: str, columns: dict[str, str], how=F.min, fill=0) -> DataFrame:
    """A row for each row key, a column for each listed column key (value -> name); cells by `how`, empty ones `fill`."""
    cells = [F.coalesce(how(F.when(F.col(col) == k, F.col(value))), F.lit(fill)).alias(n) for k, n in columns.items()]
    return df.groupBy(row).agg(*cells)


def encode(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """df with the place of its label among the sorted distinct ones, from 0; NULL has none.

    Distinct labels are ordered by a range shuffle, so there may be as many as rows.
    """
    places = ranks.ranked(df.select(label).distinct(), [], label).select(F.col(label).alias("_label"), (F.col("rank_min") - 1).alias(code))
    return df.join(places, F.col(label) == F.col("_label"), "left").drop("_label")


def provenance(df: DataFrame, key: list[str], label: str, out: str = "provenance", sep: str = ", ") -> DataFrame:
    """key and its distinct labels, sorted and joined; NULL labels do not count.  Labels are to be few."""
    return df.select(*key, label).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(label)), sep).alias(out))


def factor(value: Column, levels: list, rest: int | None = None) -> Column:
    """A value's place in the order of levels; others come last, or where `rest` says."""
    places = [F.when(value == v, i) for i, v in enumerate(levels)]
    return F.coalesce(*places, F.lit(len(levels) if rest is None else rest))


def inside(window: dict[str, tuple[float | None, float | None]]) -> Column:
    """True where every column is finite and within its bounds, both included; None is no bound."""
    ok = [finite(c) & (F.lit(True) if lo is None else F.col(c) >= lo) & (F.lit(True) if hi is None else F.col(c) <= hi) for c, (lo, hi) in window.items()]
    return reduce(Column.__and__, ok, F.lit(True))


# joins by key


def reindex(keys: DataFrame, key: str, table: DataFrame, table_key: str | None = None, fill=None) -> DataFrame:
    """Each key once or as often as it is given, with the table's columns; what it lacks is `fill`."""
    out = _on(keys, key, table, "left", table_key)
    added = [c for c in out.columns if c not in keys.columns]
    return out if fill is None else out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in added})


def columns_beside(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Columns of frames with one row a key, side by side: 'inner' on common keys; 'outer' on all, gaps NULL.

    A NULL key is a key like others.  Column names must differ.
    """

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed(key, "_right")
        out = a.join(b, F.col(key).eqNullSafe(F.col("_right")), "full" if how == "outer" else "inner")
        return out.select(F.coalesce(key, "_right").alias(key), *[c for c in a.columns + b.columns if c not in (key, "_right")])

    return reduce(two, frames)


def drop_na(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with a NULL or NaN in none of the columns (all by default)."""
    return df.dropna("any", subset=cols)


def members(df: DataFrame, key: str, index: DataFrame, index_key: str | None = None) -> DataFrame:
    """Rows whose key is in the index, as they are, each once."""
    return _on(df, key, index.select(index_key or key), "left_semi", index_key)


def without(df: DataFrame, key: str, index: DataFrame, index_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the index; a NULL key is in none."""
    return _on(df, key, index.select(index_key or key), "left_anti", index_key)


def flagged(df: DataFrame, key: str, index: DataFrame, index_key: str, yes, no, out: str = "state") -> DataFrame:
    """df with one of two values by whether the key is in the index."""
    known = index.select(F.col(index_key).alias("_right")).distinct()
    joined = df.join(known, F.col(key) == F.col("_right"), "left")
    return joined.withColumn(out, F.when(F.col("_right").isNull(), F.lit(no)).otherwise(F.lit(yes))).drop("_right")


def in_all_groups(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has."""
    pairs = df.where(F.col(group).isNotNull()).select(key, group).distinct()
    have = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    every = df.agg(F.count_distinct(F.col(group)).alias("_every"))
    return have.join(F.broadcast(every), F.col("_have") == F.col("_every")).select(key)


def union_pairs(frames: list[DataFrame]) -> DataFrame:
    """Undirected pairs (a, b) of all frames, each once as (u, v, w): u < v, weight 1; loops and NULL ends go."""
    both = reduce(DataFrame.unionByName, [f.select("a", "b") for f in frames]).where("a <> b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.lit(1.0).alias("w")).distinct()


def binarise(df: DataFrame, key: list[str], value: str, above: float = 0.0) -> DataFrame:
    """key with 1 where the sum of its values is above a bound, else 0."""
    w = F.sum(F.col(value))
    return df.groupBy(*key).agg(F.when(w > above, 1).otherwise(0).alias("w"))


# counts, bounds and scales


def frequent(df: DataFrame, key: list[str], more_than: int) -> DataFrame:
    """key, n of keys with more than so many rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def head_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n and the last n rows in the order of columns; each side is a top-n of its own, nothing is sorted whole."""
    return df.orderBy(*order).limit(n).unionAll(df.orderBy(*[F.desc(c) for c in order]).limit(n))


def bounds(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with the least and the largest value of columns: column -> (name of the one, name of the other)."""
    return df.agg(*[x for c, (lo, hi) in columns.items() for x in (F.min(c).alias(lo), F.max(c).alias(hi))])


def moments(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """group, m, v, s: mean, sample variance and sample deviation; NULL for less than two values."""
    return df.groupBy(*group).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.stddev_samp(x).alias("s"))


def zscore(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with a column centred and divided by its sample deviation; NULL if that is 0 or undefined."""
    with_sums = _beside(df, _mean=F.avg(x), _sd=F.stddev_samp(x))
    return with_sums.withColumn(out, F.when(F.col("_sd") > 0, (F.col(x) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def to_sum_one(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with each value as a share of the column's sum; NULL if that is 0."""
    return _beside(df, _sum=F.sum(x)).withColumn(out, F.try_divide(F.col(x).cast("double"), F.col("_sum"))).drop("_sum")


def neg_log10(df: DataFrame, p: str, out: str) -> DataFrame:
    """df with -log10 of a column, 0 standing as the column's smallest value above 0."""
    low = _beside(df, _low=F.min(F.when(F.col(p) > 0, F.col(p))))
    return low.withColumn(out, -F.log10(F.when(F.col(p) == 0, F.col("_low")).otherwise(F.col(p)))).drop("_low")


def cumulative_counts(df: DataFrame, x: str, out: str = "upto") -> DataFrame:
    """Each distinct value with how many rows have it or a smaller one; NULL does not count.  One range shuffle."""
    return ranks.ranked(df.select(x), [], x).select(x, F.col("rank_max").alias(out))


def stacked(df: DataFrame, row: list[str], stratum: str, out: str = "top") -> DataFrame:
    """row, stratum, n and the running sum of n over a row's strata in order: windows see sums, not rows."""
    n = df.groupBy(*row, stratum).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn(out, F.sum("n").over(Window.partitionBy(*row).orderBy(stratum).rowsBetween(Window.unboundedPreceding, 0)))


# histograms


def bin_of(x: Column, step: float, start: float = 0.0) -> Column:
    return F.floor((x - start) / step).cast("long")


def step_histogram(df: DataFrame, x: str, step: float, start: float = 0.0) -> DataFrame:
    """bin, n, lower: half-open bins of a width to both sides of a start; NULL, NaN and infinite values count nowhere."""
    place = bin_of(F.col(x).cast("double"), step, start)
    return df.where(finite(x)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("lower", start + F.col("bin") * step)


def relative(hist: DataFrame, step: float) -> DataFrame:
    """A histogram with rel, the share of all rows, and dens, the share by width."""
    return to_sum_one(hist, "n", "rel").withColumn("dens", F.col("rel") / step)


def ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """bin, ratio of two histograms on the bins that both have."""
    return a.alias("a").join(b.alias("b"), F.col("a.bin") == F.col("b.bin")).select("a.bin", (F.col("a.n").cast("double") / F.col("b.n")).alias("ratio"))

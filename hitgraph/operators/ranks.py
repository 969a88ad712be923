"""Ranks by group without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .written import materialize


def _joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", strict: tuple[str, ...] = ()) -> DataFrame:
    """df with other's further columns; NULL keys meet each other, but for those in `strict`."""
    named = other.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = [F.col(k) == F.col(f"_on{i}") if k in strict else F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(keys)]
    return df.join(named, on, how).drop(*[f"_on{i}" for i in range(len(keys))])


def ranked(df: DataFrame, group: list[str], value: str, parts: int | None = None) -> DataFrame:
    """group, value, ties, rank_min, rank_avg, rank_max, group_size for each distinct value of each group, ascending.

    Counts are pre-aggregated and ordered by one range shuffle; running sums stay inside a part, and what came before
    a part is added from a table of at most parts + groups rows.  Groups as large as the input are no hot spot.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    ordered = counts.repartitionByRange(parts, *group, value).sortWithinPartitions(*group, value)
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(value)
    totals = ordered.groupBy("_part", *group).agg(F.sum("ties").alias("_n"))
    by_group = Window.partitionBy(*group)
    before = totals.select("_part", *group, F.coalesce(F.sum("_n").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(by_group).alias("group_size"))
    upto = F.sum("ties").over(inside) + F.col("_before")
    out = _joined(ordered, F.broadcast(before), ["_part", *group]).withColumn("_upto", upto)
    return out.select(*group, value, "ties", (F.col("_upto") - F.col("ties") + 1).alias("rank_min"), (F.col("_upto") - (F.col("ties") - 1) / 2).alias("rank_avg"), F.col("_upto").alias("rank_max"), "group_size")


def with_rank(df: DataFrame, group: list[str], value: str, how: str = "min") -> DataFrame:
    """df with columns rank and group_size; joined on group and value, so a common value is no hot key but for its rows.

    Rows without a value keep their place in the table, with a NULL rank and size; a NULL group is a group.
    """
    df = materialize(df)  # read twice: sums of doubles might differ between two runs, and would then not meet
    r = ranked(df, group, value).select(*group, value, F.col(f"rank_{how}").alias("rank"), "group_size")
    return _joined(df, r, [*group, value], "left", (value,))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, order, i): rows numbered from 1 by group in the order of columns, equal rows one after the other.

    The columns given are all that is kept, so equal rows are alike and nothing is joined back.
    """
    r = ranked(df.select(*group, F.struct(*order).alias("_o")), group, "_o")
    return r.select(*group, "_o.*", F.explode(F.sequence("rank_min", "rank_max")).alias("i"))


def medians(r: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median) of a table that `ranked` gave; the two middle values' mean where rows are even in number."""
    at = lambda place: F.min(F.when(F.col("rank_max") >= place, F.col(value)))
    return r.groupBy(*group).agg(((at(F.floor((F.col("group_size") + 1) / 2)) + at(F.floor(F.col("group_size") / 2) + 1)) / 2).alias("median"))


def running(df: DataFrame, group: list[str], order: str, values: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """df with running aggregates over each group in the order of a column that is unique in it, the row itself included.

    values: output -> (sum, min or max, column).  One range shuffle; what came before a part is added from a table of at
    most parts + groups rows, so no task sees a whole group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a number marks the part, so that it goes through the written table
    ordered = materialize(df.repartitionByRange(parts, *group, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    totals = ordered.groupBy("_part", *group).agg(*[fold[how](c).alias(f"_all_{o}") for o, (how, c) in values.items()])
    before = totals.select("_part", *group, *[fold[how](f"_all_{o}").over(earlier).alias(f"_before_{o}") for o, (how, _) in values.items()])
    out = _joined(ordered, F.broadcast(before), ["_part", *group])
    return out.select(*df.columns, *[both[how](fold[how](c).over(inside), F.col(f"_before_{o}")).alias(o) for o, (how, c) in values.items()])

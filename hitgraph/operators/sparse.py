"""Cells (i, j, v) of sparse matrices and vectors: scaling, single cells, products, selections, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale(cells: DataFrame, diagonal: DataFrame, side: str = "left") -> DataFrame:
    """diag * cells (left) or cells * diag (right); diagonal: (k, d), 0 where it has no row."""
    at = "i" if side == "left" else "j"
    return cells.join(diagonal.select(F.col("k").alias(at), "d"), at).select("i", "j", (F.col("v") * F.col("d")).alias("v")).where("v <> 0")


def set_cell(cells: DataFrame, i, j, v: float) -> DataFrame:
    """One cell replaced or added; 0 takes it out."""
    rest = cells.where(~((F.col("i") == i) & (F.col("j") == j)))
    if v == 0:
        return rest
    one = cells.sparkSession.range(1).select(*[F.lit(x).cast(cells.schema[c].dataType).alias(c) for c, x in (("i", i), ("j", j), ("v", v))])
    return rest.unionByName(one)


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the product of two vectors (i, v), sparse or dense."""
    return a.join(b.select("i", F.col("v").alias("_w")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("_w")), F.lit(0.0)).alias("dot"))


def row_dots(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, dot): each row's product with a vector (j, w); rows that meet nothing have 0."""
    return cells.join(vector, "j", "left").groupBy("i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"))


def elementwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the product by element."""
    return a.join(b.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_w")).alias("v")).where("v <> 0")


def euclid(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the distance of two vectors (i, v), by one aggregate over their union."""
    both = a.select("i", "v").unionByName(b.select("i", (-F.col("v")).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))
    return both.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("distance"))


def select(cells: DataFrame, rows: list | None = None, cols: list | None = None, compact: bool = False) -> DataFrame:
    """Cells of the given rows and columns; compact: named by their places in the lists, so a row can stand twice."""
    for at, names in (("i", rows), ("j", cols)):
        if names is None:
            continue
        if not compact:
            cells = cells.where(F.col(at).isin(names))
            continue
        place = F.broadcast(cells.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], f"{at} {cells.schema[at].dataType.simpleString()}, _place long"))  # the caller's list
        cells = cells.join(place, at).drop(at).withColumnRenamed("_place", at)
    return cells.select("i", "j", "v")


def get(cells: DataFrame, i, j) -> DataFrame:
    """One row: the cell's value, 0 if it has none."""
    return cells.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def map_values(cells: DataFrame, f) -> DataFrame:
    """f over the cells; those that become 0 go."""
    return cells.select("i", "j", f(F.col("v")).alias("v")).where("v <> 0")


def column_means(cells: DataFrame, rows: int) -> DataFrame:
    """(j, mean) over so many rows, absent cells as 0."""
    return cells.groupBy("j").agg((F.sum("v") / F.lit(rows)).alias("mean"))

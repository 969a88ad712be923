"""Tables as plots take them: numeric columns with their bounds and quantiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins, plotrows
from ..operators.plotdata import finite


class Relation(NamedTuple):
    """A table and its numeric columns in order."""

    rows: DataFrame
    columns: list[str]

    def bounds(self) -> list[tuple[float, float] | None]:
        """(least, largest) finite value of each column, None without any: one scan for all columns."""
        row = self.rows.agg(*[f(F.when(finite(c), F.col(c).cast("double"))) for c in self.columns for f in (F.min, F.max)]).first()
        return [None if row[2 * i] is None else (row[2 * i], row[2 * i + 1]) for i in range(len(self.columns))]

    def quantiles(self, column: int, qs: list[float]) -> list[float]:
        """Type-6 quantiles of a column, by its number."""
        return bins.percentiles(self.rows, self.columns[column], qs)


def of(df: DataFrame, *columns: str) -> Relation:
    return Relation(df.select(*columns), list(columns))


def indexed(df: DataFrame, value: str, order: list[str]) -> Relation:
    """(index, value): places from 0 in the order of columns, the last of which makes it unique."""
    placed = plotrows.places(df, [], order)
    return Relation(placed.select(F.col("ordinal").cast("double").alias("index"), F.col(value).cast("double").alias("value")), ["index", "value"])


def raster(df: DataFrame, key: str, columns: list[str]) -> Relation:
    """(x, y, z) of a wide table: x the column's number, y the row's place by key."""
    return Relation(plotrows.raster(df, key, columns), ["x", "y", "z"])


def zipped(left: Relation, right: Relation, on: list[str]) -> Relation:
    """Columns of both for rows that agree on keys, which both have."""
    return Relation(left.rows.join(right.rows, on), [c for c in [*left.columns, *right.columns] if c not in on])

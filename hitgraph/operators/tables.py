"""Table operators: regex projection and filters, mixed-type sort, paging, recodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regex_projection(df: DataFrame, patterns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns whose full name matches any pattern, in their order; those in `keep` stay."""
    return df.select([df[c] for c in df.columns if c in (keep or []) or any(re.fullmatch(p, c) for p in patterns)])


def regex_key_filter(keys: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where any part of the key matches the whole pattern; an empty pattern keeps all."""
    if not pattern:
        return F.lit(True)
    full = ("(?i)" if ignore_case else "") + f"^(?:{pattern})$"
    return F.exists(keys, lambda k: F.rlike(k, F.lit(full)))


def mixed_order(value: Column, descending: bool = False) -> list[Column]:
    """Numbers by value before other strings by text; descending is the exact reverse."""
    number = value.try_cast("double")
    keys = [number.isNull(), F.coalesce(number, F.lit(0.0)), F.coalesce(value, F.lit(""))]
    return [k.desc() if descending else k.asc() for k in keys]


@dataclass
class TableQuery:
    """State of a table viewer: filter, then project, then sort, then page."""

    keys: list[str]
    pattern: str = ""
    ignore_case: bool = False
    projection: list[str] = field(default_factory=list)
    sort: str | None = None
    descending: bool = False
    page: int = 0
    page_size: int = 100

    def _sorted(self, df: DataFrame) -> DataFrame:
        out = df.where(regex_key_filter(F.array(*[df[k].cast("string") for k in self.keys]), self.pattern, self.ignore_case))
        order = mixed_order(F.col(self.sort).cast("string"), self.descending) if self.sort else []
        return out.orderBy(*order, *self.keys)

    def _projected(self, df: DataFrame) -> DataFrame:
        return regex_projection(df, self.projection, self.keys) if self.projection else df

    def run(self, df: DataFrame) -> DataFrame:
        return self._projected(self._sorted(df).offset(self.page * self.page_size).limit(self.page_size))

    def download(self, df: DataFrame, header: bool = True) -> DataFrame:
        """(value): all rows that pass the filter, of all pages, as CSV lines in order, under a line of names."""
        from ..sources.records import csv_lines

        rows = self._projected(self._sorted(df))
        lines = csv_lines(rows, rows.columns)
        names = df.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns))
        return csv_lines(names, rows.columns).unionAll(lines) if header else lines


def ordered_recode(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """Later rules overwrite earlier ones."""
    out = None
    for cond, value in reversed(rules):
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def row_countif(df: DataFrame, key: list[str], cond: Column, least: int = 1) -> DataFrame:
    """Keys with at least so many cells that meet the condition."""
    return df.groupBy(*key).agg(F.count_if(cond).alias("n")).where(F.col("n") >= least)


def constant_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns whose sample deviation is 0 or undefined; one pass, one row to the driver."""
    row = df.agg(*[F.stddev_samp(F.nanvl(df[c].cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is None or row[c] == 0]


def transpose(long: DataFrame, row: str, col: str) -> DataFrame:
    return long.select(*[long[col].alias(row) if c == row else long[row].alias(col) if c == col else long[c] for c in long.columns])


def flatten_key(keys: Column, n: int, prefix: str = "key") -> list[Column]:
    return [F.coalesce(F.try_element_at(keys, F.lit(i + 1)), F.lit("")).alias(f"{prefix}{i + 1}") for i in range(n)]


def count_if_rows(df: DataFrame, key: list[str], condition: Column, least: int = 1) -> DataFrame:
    """key, n: how many of a key's cells meet a condition, for keys with so many at least."""
    return df.groupBy(*key).agg(F.count_if(condition).alias("n")).where(F.col("n") >= least)


def geometric_mean(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and the geometric mean of its values; a 0 makes it 0, NULL is skipped."""
    x = F.col(value).cast("double")
    log = F.when(x == 0, F.lit(-float("inf"))).otherwise(F.ln(x))
    return df.groupBy(*key).agg(F.exp(F.avg(log)).alias(value))


def clamp_below(df: DataFrame, value: str, limit: float) -> DataFrame:
    """df with values of exactly `limit` turned into the largest value below it."""
    top = F.broadcast(df.agg(F.max(F.when(F.col(value) < limit, F.col(value))).alias("_top")))  # one row
    return df.crossJoin(top).withColumn(value, F.when(F.col(value) == limit, F.col("_top")).otherwise(F.col(value))).drop("_top")


def lookup_in_order(asked: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """A row for each asked key, in its place and as often as it is asked: place, key and the table's columns, NULL if it has none.

    asked: place (unique, its order is the query's) and key; table: one row a key.  Sorted by place.
    """
    other = table.withColumnRenamed(key, "_key")
    found = asked.select("place", key).join(other, F.col(key) == F.col("_key"), "left").drop("_key")
    return found.orderBy("place")

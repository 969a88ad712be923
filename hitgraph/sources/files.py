"""Readers and writers of the study's file shapes.  Schemas are explicit; nothing is renamed by position."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip()))).strip("_").lower()


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, snake_names: bool = True) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", True)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return df.toDF(*[snake(c) for c in df.columns]) if snake_names else df


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w from columns 0, 1 and 4 of an interaction table."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = df.columns
    return df.select(df[c[0]].alias("src"), df[c[1]].alias("dst"), df[c[4]].try_cast("double").alias("w"))


def gmt(lines: DataFrame, column: str = "value") -> DataFrame:
    """(set, member) pairs: the first field names the set, the second is skipped."""
    f = F.split(F.col(column), "\t")
    return lines.select(f[0].alias("set"), F.explode(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0)))).alias("member")).where(F.length("member") > 0)


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    return gmt(spark.read.text(path))


def read_ortholog_map(spark: SparkSession, path: str) -> DataFrame:
    """key, value; the header goes, blanks drop, the last duplicate wins."""
    from ..operators.ids import last_wins

    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = df.columns
    pairs = df.select(F.trim(df[c[0]]).alias("key"), F.trim(df[c[1]]).alias("value"), F.monotonically_increasing_id().alias("_at"))
    return last_wins(pairs, "key", "value", "_at")


def read_scores(spark: SparkSession, path: str, columns: list[str], first: DataFrame | None = None, second: DataFrame | None = None) -> DataFrame:
    """Gene scores: ids mapped by the first map, else the second, else kept; columns parsed, bad numbers NULL."""
    from ..operators.ids import fallback_lookup

    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    key = df.columns[0]
    df = df.select(df[key].alias("id"), *[df[c].try_cast("double").alias(c) for c in columns])
    none = spark.createDataFrame([], "key string, value string")
    return fallback_lookup(df, "id", none if first is None else first, none if second is None else second)


def read_guide_counts(spark: SparkSession, path: str, guide: str, samples: list[str], comparison: str) -> DataFrame:
    """guide, sample, count, comparison: distinct rows, melted."""
    df = read_tsv(spark, path).select(guide, *samples).distinct()
    return df.unpivot([guide], samples, "sample", "count").withColumn("comparison", F.lit(comparison))


def split_members(df: DataFrame, name: str, members: str, sep: str = ";") -> DataFrame:
    return df.select(name, F.explode(F.split(members, sep)).alias("member")).where(F.length("member") > 0).distinct()


def write_tsv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.option("sep", "\t").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_bundle(path: str, tables: dict[str, DataFrame], records: dict[str, DataFrame] | None = None) -> None:
    """A graph bundle: one directory with a CSV by table and a JSON by record set."""
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{path}/{name}.csv")
    for name, df in (records or {}).items():
        df.write.json(f"{path}/{name}.json")


def fasta(df: DataFrame, header: str, sequence: str) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value"))

"""Identifier harmonisation: orthologs, aliases, fallback lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Sources with exactly one distinct target, once each."""
    return pairs.groupBy(source).agg(F.min(target).alias(target), F.countDistinct(target).alias("_n")).where("_n = 1").drop("_n")


def fallback_lookup(df: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Adds `mapped`: by the first map (key, value), else by the second, else the key itself."""
    a, b = first.select(F.col("key").alias("_ka"), F.col("value").alias("_va")), second.select(F.col("key").alias("_kb"), F.col("value").alias("_vb"))
    out = df.join(a, df[key] == F.col("_ka"), "left").join(b, df[key] == F.col("_kb"), "left")
    return out.withColumn("mapped", F.coalesce("_va", "_vb", key)).drop("_ka", "_va", "_kb", "_vb")


def standardise_alias(df: DataFrame, key: str, approved: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `standard`: an approved symbol stays; else its alias's only target; else the symbol itself."""
    ok = approved.select(F.col("symbol").alias("_ok")).distinct()
    only = one_to_one(aliases.select(F.col("alias").alias("_alias"), F.col("symbol").alias("_symbol")), "_alias", "_symbol")
    out = df.join(ok, df[key] == F.col("_ok"), "left").join(only, df[key] == F.col("_alias"), "left")
    return out.withColumn("standard", F.when(F.col("_ok").isNotNull(), F.col(key)).otherwise(F.coalesce("_symbol", key))).drop("_ok", "_alias", "_symbol")


def last_wins(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map from pairs in file order: the last duplicate counts, blanks drop."""
    ok = pairs.where((F.length(key) > 0) & (F.length(value) > 0))
    return ok.groupBy(key).agg(F.max_by(value, order).alias(value))

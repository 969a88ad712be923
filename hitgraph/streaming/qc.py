"""Quality sums by window and group of a stream of counts, or of a table that has ended: one definition for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.plotdata import finite


def window_qc(rows: DataFrame, time: str, group: str, value: str, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, group, n, total, zeros, low, high of the finite values of each window and group.

    On a stream, rows older than the latest time seen less `late` are dropped, and a window's state goes when the
    watermark passes its end: state is one row for each open window and group.  Rows without a time drop.
    """
    kept = rows.where(F.col(time).isNotNull() & finite(value)).select(F.col(time).alias("_t"), F.col(group).alias("group"), F.col(value).cast("double").alias("_v"))
    by = kept.withWatermark("_t", late).groupBy(F.window("_t", length).alias("_w"), "group")
    out = by.agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.count_if(F.col("_v") == 0).alias("zeros"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    return out.select(F.col("_w.start").alias("start"), "group", "n", "total", "zeros", "low", "high")


def share_of_zeros(sums: DataFrame) -> DataFrame:
    """sums with pct_zero and mean: what needs no further rows."""
    return sums.withColumns({"pct_zero": 100.0 * F.col("zeros") / F.col("n"), "mean": F.col("total") / F.col("n")})


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows as Parquet, exactly once, until what is there now has been read."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

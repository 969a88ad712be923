from hitgraph.streaming import qc


def test_late_rows_drop_and_windows_close(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "t timestamp, kind string, v double"

    def feed(*rows):
        spark.createDataFrame(list(rows), "t string, kind string, v double").selectExpr("cast(t as timestamp) as t", "kind", "v").coalesce(1).write.mode("append").parquet(source)
        sums = qc.window_qc(spark.readStream.schema(schema).parquet(source), "t", "kind", "v", "1 hour", "30 minutes")
        qc.start(sums, out, state).awaitTermination()
        return {(str(r.start), r.group): (r.n, r.total, r.zeros) for r in spark.read.parquet(out).collect()}

    assert feed(("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:50:00", "a", 0.0), ("2024-01-01 10:55:00", "b", None), (None, "a", 9.0)) == {}  # the window is open
    assert feed(("2024-01-01 11:10:00", "a", 5.0), ("2024-01-01 10:59:00", "a", 2.0)) == {}  # late, within the limit
    got = feed(("2024-01-01 11:31:00", "a", 7.0))
    got = feed(("2024-01-01 10:01:00", "a", 100.0), ("2024-01-01 11:40:00", "a", 7.0))  # too late: its window has closed
    assert got == {("2024-01-01 10:00:00", "a"): (3, 3.0, 1)}
    got = feed(("2024-01-01 13:00:00", "a", 1.0))
    got = feed(("2024-01-01 13:01:00", "a", 1.0))
    assert got[("2024-01-01 11:00:00", "a")] == (3, 19.0, 0) and len(got) == 2


def test_an_ended_table_gives_the_same(spark):
    df = spark.sql("select timestamp'2024-01-01 10:05:00' as t, 'a' as kind, 0.0D as v union all select timestamp'2024-01-01 10:06:00', 'a', 3.0D")
    (row,) = qc.share_of_zeros(qc.window_qc(df, "t", "kind", "v", "1 hour")).collect()
    assert (row.n, row.total, row.pct_zero, row["mean"], row.low, row.high) == (2, 3.0, 50.0, 1.5, 0.0, 3.0)

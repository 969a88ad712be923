import gzip

import pytest
from pyspark.sql import functions as F

from hitgraph.sources import adapters, files


@pytest.fixture(scope="module")
def known(spark):
    adapters.register(spark)
    return spark


def gmt_text(n=400):
    return "".join(f"set{i % 40}_{i}\tdescription {i}\t" + "\t".join(f"g{i * k % 97}é" for k in range(1, i % 9 + 1)) + ("\t\t" if i % 5 == 0 else "") + ("\r\n" if i % 3 == 0 else "\n") for i in range(n))


@pytest.mark.parametrize("size", [1 << 20, 1000, 97, 1])
def test_gene_sets_in_ranges(known, tmp_path, size):
    text = gmt_text(400 if size > 90 else 12)
    (tmp_path / "a.gmt").write_bytes(text.encode())
    (tmp_path / "b.gmt").write_bytes(b"last\t\tone\ttwo")  # no newline at its end, no description
    df = known.read.format("gmt").option("rangeBytes", size).load(str(tmp_path))
    want = [tuple(x) for line in text.replace("\r\n", "\n").split("\n") for x in [(line.split("\t")[0], m) for m in line.split("\t")[2:] if m]] + [("last", "one"), ("last", "two")]
    assert sorted((r.set, r.member) for r in df.collect()) == sorted(want)
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // size) + -(-len(b"last\t\tone\ttwo") // size)
    # the reader by lines agrees
    assert sorted(tuple(r) for r in files.read_gmt(known, str(tmp_path / "b.gmt")).collect()) == [("last", "one"), ("last", "two")]


def test_gene_sets_pruned_and_compressed(known, tmp_path):
    (tmp_path / "a.gmt.gz").write_bytes(gzip.compress(gmt_text().encode()))
    (tmp_path / "_hidden").write_bytes(b"x\ty\tz\n")
    some = known.read.format("gmt").schema("member string").load(str(tmp_path))
    assert some.columns == ["member"] and some.count() == sum(i % 9 for i in range(400))
    assert "description" not in some._jdf.queryExecution().toString()
    one = known.read.format("gmt").load(str(tmp_path)).where("set = 'set7_7'")
    assert one.count() == 7
    assert "(set#" not in "".join(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if x.strip().startswith("+- Filter"))  # the source has taken it
    with pytest.raises(Exception, match="has no"):
        known.read.format("gmt").schema("genes string").load(str(tmp_path)).count()


def test_cells_round_trip(known, tmp_path):
    path = str(tmp_path / "cells")
    cells = known.range(0, 1000, 1, 4).select((F.col("id") % 50).alias("i"), F.col("id").alias("j"), F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id") / 8).alias("v"))
    cells.write.format("column_blocks").option("blockRows", 64).mode("append").save(path)
    back = known.read.format("column_blocks").load(path)
    assert back.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    assert back.rdd.getNumPartitions() >= 4
    assert back.where("v = v").exceptAll(cells.where("v = v")).count() == 0 and back.count() == 1000
    assert back.where("isnan(v)").count() == 1
    cells.write.format("column_blocks").mode("append").save(path)
    assert known.read.format("column_blocks").load(path).count() == 2000
    cells.limit(5).write.format("column_blocks").mode("overwrite").save(path)
    assert known.read.format("column_blocks").load(path).count() == 5
    # what no manifest names was never committed
    (tmp_path / "cells" / "part-lost.cols").write_bytes(b"half a file")
    assert known.read.format("column_blocks").load(path).count() == 5


def test_columns_and_blocks_are_left_out(known, tmp_path):
    path = str(tmp_path / "raster")
    known.range(0, 1000, 1, 1).selectExpr("cast(id % 10 as int) as x", "cast(id div 10 as int) as y", "cast(id as float) as z").write.format("column_blocks").option("blockRows", 100).mode("append").save(path)
    one = known.read.format("column_blocks").schema("z float").load(path)
    assert one.columns == ["z"] and one.agg(F.sum("z")).first()[0] == 499500
    reader = adapters.ColumnReader(one.schema, {"path": path})
    assert all(set(p.columns) == {"z"} for p in reader.partitions()) and len(reader.partitions()) == 10
    few = known.read.format("column_blocks").load(path).where("y >= 95 and y < 97")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 20
    empty = known.read.format("column_blocks").load(path).where("y > 5000")
    assert empty.count() == 0
    with pytest.raises(Exception, match="numbers only"):
        known.createDataFrame([("a",)], "s string").write.format("column_blocks").mode("append").save(str(tmp_path / "no"))
    with pytest.raises(Exception, match="no NULL"):
        known.createDataFrame([(None,)], "v double").write.format("column_blocks").mode("append").save(str(tmp_path / "null"))


def test_relations(spark):
    from hitgraph.sources import relation

    df = spark.createDataFrame([(i, float((i * 7) % 10), None if i == 4 else i / 2) for i in range(10)] + [(10, float("inf"), float("nan"))], "id long, a double, b double")
    r = relation.of(df, "a", "b", "id")
    assert r.bounds() == [(0.0, 9.0), (0.0, 4.5), (0.0, 10.0)]
    assert r.quantiles(0, [0.5]) == [4.5]
    at = relation.indexed(df.where("id < 10"), "a", ["a", "id"])
    assert sorted(tuple(x) for x in at.rows.collect()) == [(float(i), float(i)) for i in range(10)] and at.bounds() == [(0.0, 9.0), (0.0, 9.0)]
    assert relation.of(df.where("false"), "a").bounds() == [None]
    assert relation.raster(df.where("id < 3"), "id", ["a", "b"]).rows.count() == 6
    both = relation.zipped(relation.of(df, "id", "a"), relation.of(df, "id", "b"), ["id"])
    assert both.columns == ["a", "b"] and both.rows.count() == 11

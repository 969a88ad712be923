"""Dense matrices as square blocks (bi, bj, data): products move whole blocks instead of one row a cell.

data holds size x size doubles by row; absent blocks are zero, and so are cells beyond the matrix's edge.  A product of
n x m and m x p moves each block of the left side once, each of the right side once, and of the result one block for
each task that holds a share of it: 8 * size * size bytes each, where cells would take some 24 bytes a cell and a row
of the join for each triple (i, j, k).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 128
#: Blocks of a product that a task adds up before it sends them on.
HELD = 256
#: Blocks that a task copies at once out of a batch of Arrow, which may hold hundreds.
FEW = 16
_SCHEMA = "bi long, bj long, data binary"


def to_blocks(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of cells (i, j, v), i and j from 0; cells of one place are added; null, NaN and negative places are left out."""
    ok = cells.where("i >= 0 and j >= 0").where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    keyed = ok.select(F.floor(F.col("i") / size).cast("long").alias("bi"), F.floor(F.col("j") / size).cast("long").alias("bj"), (F.pmod(F.col("i").cast("long"), F.lit(size)) * size + F.pmod(F.col("j").cast("long"), F.lit(size))).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
    summed = keyed.groupBy("bi", "bj", "at").agg(F.sum("v").alias("v"))

    def fill(key, rows):
        data = np.zeros(size * size)
        data[rows["at"].to_numpy()] = rows["v"].to_numpy()
        return pa.table({"bi": pa.array([key[0].as_py()], pa.int64()), "bj": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    return summed.groupBy("bi", "bj").applyInArrow(fill, _SCHEMA)  # size * size rows a group at most


def from_blocks(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Cells (i, j, v) that are not 0."""

    def cells(batches):
        for rb in batches:
            for bi, bj, data in zip(*(rb.column(c) for c in ("bi", "bj", "data"))):  # a block at a time: a batch holds many
                bi, bj, m = bi.as_py(), bj.as_py(), np.frombuffer(data.as_buffer())
                at = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(bi * size + at // size), pa.array(bj * size + at % size), pa.array(m[at])], ["i", "j", "v"])

    return blocks.mapInArrow(cells, "i long, j long, v double")


def _each(blocks: DataFrame, f) -> DataFrame:
    """f over the numbers of each block; it must leave 0 at 0."""

    def apply(batches):
        for batch in batches:
            for s in range(0, len(batch), FEW):
                rb = batch.slice(s, FEW)
                data = [f(np.frombuffer(d.as_buffer())).tobytes() for d in rb.column("data")]
                yield pa.RecordBatch.from_arrays([rb.column("bi"), rb.column("bj"), pa.array(data, pa.binary())], ["bi", "bj", "data"])

    return blocks.select("bi", "bj", "data").mapInArrow(apply, _SCHEMA)


def scale(blocks: DataFrame, factor: float) -> DataFrame:
    return _each(blocks, lambda m: m * factor)


def transpose(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """No shuffle: each block is turned where it lies."""
    turned = _each(blocks, lambda m: np.ascontiguousarray(m.reshape(size, size).T))
    return turned.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "data")


def _sum(blocks: DataFrame) -> DataFrame:
    def add(rows: pa.Table) -> pa.Table:
        total = 0.0
        for d in rows["data"]:
            total = total + np.frombuffer(d.as_buffer())
        return pa.table({"bi": rows["bi"][:1], "bj": rows["bj"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    return blocks.groupBy("bi", "bj").applyInArrow(add, _SCHEMA)  # a block from each task or side


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sum(a.select("bi", "bj", "data").unionByName(b.select("bi", "bj", "data")))


def elementwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products by element; a block that either side lacks is zero."""
    met = a.select("bi", "bj", "data").join(b.select("bi", "bj", F.col("data").alias("other")), ["bi", "bj"])

    def times(batches):
        for batch in batches:
            for s in range(0, len(batch), FEW):
                rb = batch.slice(s, FEW)
                data = [(np.frombuffer(x.as_buffer()) * np.frombuffer(y.as_buffer())).tobytes() for x, y in zip(rb.column("data"), rb.column("other"))]
                yield pa.RecordBatch.from_arrays([rb.column("bi"), rb.column("bj"), pa.array(data, pa.binary())], ["bi", "bj", "data"])

    return met.mapInArrow(times, _SCHEMA)


def multiply(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """a times b.  Blocks meet on the inner index; a task adds up what it has of a result block before it sends it."""
    met = a.select(F.col("bi").alias("i"), F.col("bj").alias("k"), F.col("data").alias("left")).join(b.select(F.col("bi").alias("k"), F.col("bj").alias("j"), F.col("data").alias("right")), "k").select("i", "j", "left", "right")

    def times(batches):
        held: dict = {}

        def out():
            keys = list(held)
            data = pa.array([held[k].tobytes() for k in keys], pa.binary())
            rb = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), data], ["bi", "bj", "data"])
            held.clear()
            return rb

        for rb in batches:
            for i, j, x, y in zip(*(rb.column(c) for c in ("i", "j", "left", "right"))):
                i, j = i.as_py(), j.as_py()
                p = np.frombuffer(x.as_buffer()).reshape(size, size) @ np.frombuffer(y.as_buffer()).reshape(size, size)
                if (i, j) in held:
                    held[i, j] += p
                else:
                    held[i, j] = p
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()

    return _sum(met.mapInArrow(times, _SCHEMA))


def times_vector(blocks: DataFrame, vector: DataFrame, size: int = SIZE) -> DataFrame:
    """(i, v): blocks times a vector (i, v); entries that come to 0 are left out."""
    column = vector.select("i", F.lit(0).alias("j"), "v")
    return from_blocks(multiply(blocks, to_blocks(column, size), size), size).select("i", "v")

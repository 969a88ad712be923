"""Two-dimensional layout of a neighbour graph: fuzzy edge weights in Columns, then descent in one task or in blocks of vertices."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import uniform
from .written import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Vertices that one task lays out at most; more are laid out in blocks of some BLOCK, with so many epochs a job.
MOST_VERTICES, BLOCK, EPOCHS = 50_000, 1 << 12, 8
#: Curve of closeness over distance for a least distance of 0.1.
_A, _B = 1.5769434, 0.8950609


def fuzzy_edges(near: DataFrame, steps: int = 48) -> DataFrame:
    """(i, j, weight), i < j, from neighbours (query, neighbour, d2), some k for each query.

    A query's nearest neighbour has weight 1; the others' fall off at the rate for which all sum to log2(k), found by
    halving; two directions a and b join as a + b - ab.  One group a query, of k rows.
    """
    d = F.transform("_n", lambda n: F.sqrt(F.greatest(n["d2"], F.lit(0.0))))
    one = near.groupBy("query").agg(F.collect_list(F.struct("neighbour", "d2")).alias("_n"))
    one = one.withColumn("_d", d).withColumn("_least", F.coalesce(F.array_min(F.filter("_d", lambda x: x > 0)), F.lit(0.0))).withColumn("_far", F.transform("_d", lambda x: F.greatest(x - F.col("_least"), F.lit(0.0))))
    total = lambda rate: F.aggregate("_far", F.lit(0.0), lambda s, x: s + F.exp(-x / rate))
    target = F.log2(F.greatest(F.size("_n"), F.lit(2)).cast("double"))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))

    def halve(s, _k):
        more = total(s["mid"]) > target
        lo, hi = F.when(more, s["lo"]).otherwise(s["mid"]), F.when(more, s["mid"]).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2).alias("mid"))

    rate = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["mid"]
    mean = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / F.size("_n")
    one = one.withColumn("_rate", F.greatest(rate, mean * 1e-3, F.lit(1e-12)))
    each = one.select("query", F.posexplode("_n").alias("_k", "n"), "_far", "_rate").select(F.col("query").alias("a"), F.col("n.neighbour").alias("b"), F.exp(-F.col("_far")[F.col("_k")] / F.col("_rate")).alias("w"))
    both = each.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("w").alias("x"), F.when(F.count(F.lit(1)) > 1, F.min("w")).otherwise(0.0).alias("y"))
    return both.select("i", "j", (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("weight"))


def descend(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int, epochs: int, negatives: int, seed: int) -> np.ndarray:
    """Places of n vertices: edges pull as often as they weigh, drawn vertices push."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(-10, 10, (n, 2))
    if not len(i):
        return at
    chance = weight / weight.max()
    for e in range(epochs):
        rate = 1.0 - e / epochs
        use = rng.random(len(i)) < chance
        a, b = i[use], j[use]
        apart = at[a] - at[b]
        d2 = (apart**2).sum(1)
        pull = np.where(d2 > 0, -2 * _A * _B * np.maximum(d2, 1e-12) ** (_B - 1) / (1 + _A * d2**_B), 0.0)
        move = np.clip(pull[:, None] * apart, -4, 4) * rate
        step = np.zeros_like(at)
        np.add.at(step, a, move)
        np.add.at(step, b, -move)
        c, o = np.repeat(a, negatives), rng.integers(0, n, len(a) * negatives)
        apart = at[c] - at[o]
        d2 = (apart**2).sum(1)
        push = 2 * _B / ((0.001 + d2) * (1 + _A * d2**_B))
        np.add.at(step, c, np.where((c != o)[:, None], np.clip(push[:, None] * apart, -4, 4), 0) * rate)
        at += np.clip(step, -8, 8)
    return at


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each unsigned number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tile(rows: pa.Table) -> pa.Table:
    """Edges from one block to another as arrays, in a fixed order: places in both, a number of the pair, chance, and whether they push."""
    at, oat, chance, head = (rows[c].to_numpy() for c in ("at", "oat", "chance", "head"))
    order = np.lexsort((oat, at))
    at, oat, chance, head = at[order], oat[order], chance[order], head[order]
    b, ob = rows["b"][0].as_py(), rows["ob"][0].as_py()
    here, there = (np.uint64(k << 32) + x.astype(np.uint64) for k, x in ((b, at), (ob, oat)))
    pair = _mixed(_mixed(np.minimum(here, there)) + np.maximum(here, there))
    packed = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (at.astype(np.int32), oat.astype(np.int32), pair, chance.astype(np.float64), head.astype(bool))]
    return pa.table({"b": rows["b"][:1], "ob": rows["ob"][:1], **dict(zip(("at", "oat", "pair", "chance", "head"), packed))})


def _epoch(e: int, epochs: int, negatives: int, seed: int):
    """The kernel of one epoch: a block's edges and the places of the blocks that they name give the block's new places."""
    rate = 1.0 - e / epochs
    turn = np.uint64((seed * 1_000_003 + e) & (2**64 - 1))

    def step(held: pa.Table, sent: pa.Table) -> pa.Table:
        b = sent["b"][0].as_py()
        places = {k: np.frombuffer(d.as_buffer()).reshape(-1, 2) for k, d in zip(sent["ob"].to_pylist(), sent["data"])}
        names = sorted(places)
        first = dict(zip(names, np.cumsum([0, *(len(places[k]) for k in names)])))
        every, own = np.concatenate([places[k] for k in names]), places[b]
        moved = np.zeros_like(own)

        def add(which: np.ndarray, by: np.ndarray) -> None:
            for axis in (0, 1):
                moved[:, axis] += np.bincount(which, by[:, axis], len(own))

        rng = np.random.default_rng([seed, e, b])
        for row in sorted(zip(held["ob"].to_pylist(), *(held[c] for c in ("at", "oat", "pair", "chance", "head"))), key=lambda r: r[0]):
            at, oat, pair, chance, head = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row[1:], (np.int32, np.int32, np.uint64, np.float64, bool)))
            use = (_mixed(pair ^ _mixed(np.full(1, turn))) >> np.uint64(11)) * 2.0**-53 < chance  # alike from both ends
            a, o, pushes = at[use], first[row[0]] + oat[use], head[use]
            apart = own[a] - every[o]
            d2 = (apart**2).sum(1)
            pull = np.where(d2 > 0, -2 * _A * _B * np.maximum(d2, 1e-12) ** (_B - 1) / (1 + _A * d2**_B), 0.0)
            add(a, np.clip(pull[:, None] * apart, -4, 4) * rate)
            c = np.repeat(a[pushes], negatives)
            o = rng.integers(0, len(every), len(c))
            apart = own[c] - every[o]
            d2 = (apart**2).sum(1)
            push = 2 * _B / ((0.001 + d2) * (1 + _A * d2**_B))
            add(c, np.where((first[b] + c != o)[:, None], np.clip(push[:, None] * apart, -4, 4), 0) * rate)
        new = own + np.clip(moved, -8, 8)
        return pa.table({"ob": pa.array([b], pa.int32()), "data": pa.array([new.tobytes()], pa.binary())})

    return step


def in_blocks(edges: DataFrame, vertices: DataFrame, key: str, epochs: int = 200, negatives: int = 5, seed: int = 1, block: int = BLOCK, stride: int = EPOCHS) -> DataFrame:
    """(key, x, y) as layout_2d has them, for any number of vertices: descend()'s epochs, a shuffle each.

    Vertices are dealt to blocks of about `block` by a hash, so a few blocks are a fair draw of all.  In an epoch each block
    moves by its own edges; it is sent the places, 16 bytes each, of the blocks that these name, and draws the vertices that
    push from them.  An edge is drawn alike from both its ends.  One job makes `stride` epochs.
    """
    spark = vertices.sparkSession
    kind = vertices.schema[key].dataType.simpleString()
    one = materialize(vertices.select(F.col(key).alias("id")).where("id is not null").distinct())
    across = max(1, -(-one.count() // block))

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        return rows.append_column("at", pa.array(np.arange(rows.num_rows, dtype=np.int32)))

    drawn = one.select("id", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("b"), *[(uniform(F.col("id"), seed, axis) * 20 - 10).alias("xy"[axis]) for axis in (0, 1)])
    names = materialize(drawn.groupBy("b").applyInArrow(number, f"id {kind}, b int, x double, y double, at int"))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        data = np.column_stack([rows["x"].to_numpy(), rows["y"].to_numpy()]).tobytes()
        return pa.table({"ob": rows["b"][:1], "data": pa.array([data], pa.binary())})

    places = materialize(names.select("b", "at", "x", "y").groupBy("b").applyInArrow(fill, "ob int, data binary"))
    edges = materialize(edges.select("i", "j", "weight"))
    top = edges.agg(F.max("weight")).first()[0]
    of = lambda end, b, at: names.select(F.col("id").alias(end), F.col("b").alias(b), F.col("at").alias(at))
    each = edges.join(of("i", "b", "at"), "i").join(of("j", "ob", "oat"), "j").withColumn("chance", F.col("weight") / F.lit(float(top or 1.0)))
    each = each.select("b", "at", "ob", "oat", "chance", F.lit(True).alias("head"))
    back = each.select(F.col("ob").alias("b"), F.col("oat").alias("at"), F.col("b").alias("ob"), F.col("at").alias("oat"), "chance", F.lit(False).alias("head"))
    tiles = materialize(each.unionByName(back).groupBy("b", "ob").applyInArrow(_tile, "b int, ob int, at binary, oat binary, pair binary, chance binary, head binary"))
    index = materialize(tiles.select("b", "ob").union(names.select("b", F.col("b").alias("ob"))).distinct().repartition(1))  # a row a pair of blocks
    held = tiles.repartition(min(across, 2 * spark.sparkContext.defaultParallelism), "b").sortWithinPartitions("b").persist(StorageLevel.MEMORY_AND_DISK)

    def rows_of(batches):
        for rb in batches:
            for b, d in zip(rb.column("ob").to_pylist(), rb.column("data")):
                at = np.frombuffer(d.as_buffer()).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], ["b", "at", "x", "y"])

    try:
        for e in range(epochs):
            sent = F.broadcast(index).join(places, "ob").select("b", "ob", "data")
            places = held.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(_epoch(e, epochs, negatives, seed), "ob int, data binary")
            if (e + 1) % stride == 0 or e + 1 == epochs:
                places = materialize(places)
        return places.mapInArrow(rows_of, "b int, at int, x double, y double").join(names.select("id", "b", "at"), ["b", "at"]).select(F.col("id").alias(key), "x", "y")
    finally:
        held.unpersist()


def layout_2d(edges: DataFrame, vertices: DataFrame, key: str, epochs: int = 200, negatives: int = 5, seed: int = 1, most: int | None = None) -> DataFrame:
    """(key, x, y): repeatable places of the vertices; edges: (i, j, weight) of fuzzy_edges, some k for each vertex.

    Up to MOST_VERTICES, which is checked, one task descends; more are laid out in blocks (in_blocks).  More than `most`,
    if it is given, is an error.
    """
    n = vertices.select(key).distinct().count()
    if most is not None and n > most:
        raise ValueError(f"over {most} vertices")
    if n > MOST_VERTICES:
        return in_blocks(edges, vertices, key, epochs, negatives, seed)
    kind = vertices.schema[key].dataType.simpleString()
    rows = vertices.select(F.col(key).alias("i")).distinct().select("i", F.lit(None).cast(kind).alias("j"), F.lit(0.0).alias("weight")).unionByName(edges.select("i", "j", "weight"))

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["i", "j"], na_position="first")
        names = np.unique(f["i"][f["j"].isna()].to_numpy())
        e = f[f["j"].notna()]
        i, j = np.searchsorted(names, e["i"].to_numpy()), np.searchsorted(names, e["j"].to_numpy().astype(names.dtype))
        at = descend(i, j, e["weight"].to_numpy(), len(names), epochs, negatives, seed)
        return pd.DataFrame({key: names, "x": at[:, 0], "y": at[:, 1]})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(kernel, f"{key} {kind}, x double, y double")

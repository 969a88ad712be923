"""Connected components by large-star and small-star steps on tables of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the nodes that these links touch, without the smallest ones."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = label != np.arange(len(nodes))
    return nodes[move], nodes[label[move]]


def _contract(links: DataFrame) -> DataFrame:
    """Each part's links, replaced by as many as it has nodes at most."""

    def kernel(batches):
        held = [(rb.column(0).to_numpy(), rb.column(1).to_numpy()) for rb in batches if rb.num_rows]
        if held:
            a, b = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_pydict({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return links.select("u", "v").mapInArrow(kernel, "u long, v long")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for the nodes of links (u, v) other than each component's smallest; ids are longs.

    Parts contract their links first; then every node sends its larger, and then its smaller, neighbours to the least
    of them until nothing changes.  Minima are pre-aggregated, so a hub's links meet in no one task but by a join.
    """
    stars = util.persist(_contract(links.select("u", "v").where("u <> v")).where("u > v").distinct())
    state = None
    for _ in range(most):
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        # stars alone: no node is both a centre and a ray, and no ray has two centres
        if now[0] == 0 or now == state:
            break
        state = now
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.select("u", "v").unionAll(small.select(F.col("w").alias("u"), "v")).where("u <> v").distinct()
        stars = util.persist(small)
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))

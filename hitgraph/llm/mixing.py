"""Mixing sources to target weights by Pfair scheduling of blocks.

A slot takes a part of a block of one source.  Slots are dealt in frames.  What each source has been dealt by the end of
a frame is its exact share rounded up or down, in integers, known from the frame's number alone; so frames are scheduled
apart, on any executor, and no error grows with the length of the schedule.  Inside a frame a source with w of its F
slots releases its k-th at floor(k*F/w), due by ceil((k+1)*F/w); in each slot the released one with the earliest deadline
goes.  On one resource that meets all deadlines, so inside a frame a source is less than one slot off the line from one
end to the other, and each end is less than one and a half off its share.  Sources too light for two slots a frame share
the slots of one or more groups, which deal them on in frames of their own.  A slot holds so few documents that all of
this together is less than one block, after any number of slots and for any weights.
"""

from __future__ import annotations

import heapq
import math
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import util

#: Slots of a frame.
FRAME = 10_000
#: Documents of one source in a block.
BLOCK = 16
#: Sources at most: their weights come to the driver.
MOST_SOURCES = 100_000
#: Slots whose table is broadcast at most, 32 bytes each; Spark cannot estimate it.
MOST_BROADCAST = 20_000
#: Default targets: each source's share of the documents to this power.
TEMPERATURE = 0.7


class Plan:
    """Sources and groups as a tree; every child but a node's last light group has two slots a frame at least."""

    def __init__(self, weights: dict[str, float], frame: int = FRAME) -> None:
        if frame < 8:
            raise ValueError("a frame has 8 slots at least")
        self.frame = frame
        self.names = sorted(k for k, w in weights.items() if w > 0)
        exact = [Fraction(weights[k]) for k in self.names]
        scale = math.lcm(*[x.denominator for x in exact]) if exact else 1
        self.weight = [int(x * scale) for x in exact]  # by child: sources first, then groups
        self.children: dict[int, list[int]] = {}
        self.light: dict[int, int | None] = {}
        self.level: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.root = self._group(list(range(len(self.names)))) if self.names else None
        for node in sorted(self.children, reverse=True):  # a group is numbered after all it holds
            self.level.setdefault(node, 0)
            for c in self.children[node]:
                self.level[c], self.parent[c] = self.level[node] + 1, node
        self.depth = max(self.level.values(), default=1)
        self._patterns: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}

    def _group(self, items: list[int]) -> int:
        total = sum(self.weight[i] for i in items)
        items = sorted(items, key=lambda i: (-self.weight[i], i))
        own = [i for i in items if self.weight[i] * self.frame >= 2 * total]
        groups, now, held = [], [], 0
        for i in items[len(own) :]:
            now.append(i)
            held += self.weight[i]
            if held * self.frame >= 2 * total:
                groups.append(now)
                now, held = [], 0
        made = [g[0] if len(g) == 1 else self._group(g) for g in [*groups, *([now] if now else [])]]
        self.weight.append(total)
        node = len(self.weight) - 1
        self.children[node] = own + made
        self.light[node] = made[-1] if now else None
        return node

    def slot_documents(self, block: int) -> int:
        """Documents of a slot, so that all that a source may be off is less than a block."""
        off = 2 if self.depth == 1 and self.light.get(self.root) is None else math.ceil(2.5 * self.depth)
        if off > block:
            raise ValueError("weights so far apart need larger blocks")
        return block // off

    def dealt(self, node: int, frames: int) -> list[int]:
        """How many slots each child has by the end of so many frames."""
        kids, light = self.children[node], self.light[node]
        total, slots = self.weight[node], frames * self.frame
        rest = 0 if light is None else (2 * slots * self.weight[light] + total) // (2 * total)
        heavy = [c for c in kids if c != light]
        all_heavy = sum(self.weight[c] for c in heavy)
        parts = {c: divmod((slots - rest) * self.weight[c], all_heavy) for c in heavy}
        more = slots - rest - sum(q for q, _ in parts.values())
        up = set(sorted(heavy, key=lambda c: (-parts[c][1], c))[:more])
        return [rest if c == light else parts[c][0] + (c in up) for c in kids]

    def frame_slots(self, node: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(child, which of its slots) for each slot of a frame."""
        first = self.dealt(node, number)
        many = tuple(b - a for a, b in zip(first, self.dealt(node, number + 1)))
        if many not in self._patterns:
            if len(self._patterns) > 500:
                self._patterns.clear()
            order = pattern({k: n for k, n in enumerate(many) if n})
            self._patterns[many] = tuple(np.array(x, np.int64) for x in zip(*order))
        which, k = self._patterns[many]
        return np.array(self.children[node], np.int64)[which], np.array(first, np.int64)[which] + k

    def frames(self, need: dict[int, int]) -> dict[int, int]:
        """Frames of each node until all have the slots they need; `need` (by source) is filled for the groups."""
        out = {}
        for node in sorted(self.children):
            total = self.weight[node]
            # at the end of frame j a child is off its share by less than two
            out[node] = max((-(-(need[c] + 2) * total // (self.weight[c] * self.frame)) for c in self.children[node] if need[c]), default=0)
            need[node] = out[node] * self.frame
        return out


def pattern(slots: dict) -> list[tuple]:
    """(source, which of its slots) for each slot of a frame, earliest deadline first."""
    period = sum(slots.values())
    release: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for s, w in slots.items():
        for k in range(w):
            release[k * period // w].append((-(-(k + 1) * period // w), s, k))
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        for r in release[t]:
            heapq.heappush(ready, r)
        due, s, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        out.append((s, k))
    return out


def target_weights(docs: DataFrame, power: float = TEMPERATURE, most: int = MOST_SOURCES) -> dict[str, float]:
    """Share of each source to the power; a null source is ''.  As many rows as sources reach the driver, checked."""
    rows = docs.groupBy(F.coalesce(docs["source"], F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} sources")
    return {r["source"]: float(round(r["n"] ** power, 6)) for r in rows}


SCHEMA = "doc_id long, source string, block long, slot long, position long"


def _deal(spark, plan: Plan, level: int, frames: dict[int, int], need: dict[int, int]) -> DataFrame:
    """(child, k, node, slot): where the nodes of a level put their children's slots, as far as they are needed."""
    rows = [(n, j) for n, j in frames.items() if plan.level[n] == level and j]
    every = spark.createDataFrame(rows, "node long, frames long").select("node", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))

    def kernel(batches):
        for rb in batches:
            for node, j in zip(rb.column("node").to_pylist(), rb.column("frame").to_pylist()):
                child, k = plan.frame_slots(node, j)
                use = np.flatnonzero(k < _lookup(need, child))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (child[use], k[use], np.full(len(use), node), j * plan.frame + use)], ["child", "k", "node", "slot"])

    return every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame").mapInArrow(kernel, "child long, k long, node long, slot long")


def _lookup(need: dict[int, int], child: np.ndarray) -> np.ndarray:
    kinds, at = np.unique(child, return_inverse=True)
    return np.array([need[c] for c in kinds.tolist()], np.int64)[at]


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """One row per document: source, its block there, its slot in the whole schedule, and the place in it (from 0).

    A source's documents are in order of a hash of doc_id, ties by doc_id; repeated rows are documents of their own;
    a null source counts as ''; a source without a positive weight follows after all (slot null).  When a source runs
    out its slots stay empty, so no document is dropped and the others keep their spacing.

    Ranks come from one range shuffle of ids and from counts by part and source (parts + sources rows): no task
    sees a whole source.  Frames are scheduled by any task; their table has as many rows as slots hold documents.
    """
    spark = docs.sparkSession
    weights = target_weights(docs) if weights is None else weights
    plan = Plan(weights, frame)
    util.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("source")).withColumn("h", F.xxhash64("doc_id"))
    ranged = keyed.repartitionByRange(parts, "source", "h", "doc_id").sortWithinPartitions("source", "h", "doc_id")
    numbered = util.persist(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int")))
    counted = numbered.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each part and source in it: parts are in order of source, so at most parts + sources rows
    places = F.broadcast(counted.select("part", "source", (before - F.col("first")).alias("shift")))
    ranked = numbered.join(places, ["part", "source"]).select("doc_id", "source", (F.col("at") + F.col("shift")).alias("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    if plan.root is None:
        return ranked.select("doc_id", "source", "block", F.lit(None).cast("long").alias("slot"), (F.col("rank") % block).alias("position"))
    size = plan.slot_documents(block)
    held = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    need = {c: -(-held.get(s, 0) // size) for c, s in enumerate(plan.names)}
    frames = plan.frames(need)
    leaves = F.broadcast(spark.createDataFrame(list(zip(plan.names, range(len(plan.names)))), "source string, at long"))  # checked: target_weights, or the caller's dict
    out = ranked.join(leaves, "source", "left").withColumn("slot", F.floor(F.col("rank") / size).cast("long")).withColumn("position", F.col("rank") % size)
    for level in range(plan.depth - 1, -1, -1):
        table = _deal(spark, plan, level, frames, need).select("child", "k", F.col("node").alias("up"), F.col("slot").alias("up_slot"))
        rows = sum(n for c, n in need.items() if plan.level.get(c) == level + 1)
        table = F.broadcast(table) if rows <= MOST_BROADCAST else table.hint("merge")
        out = out.join(table, (F.col("at") == F.col("child")) & (F.col("slot") == F.col("k")), "left")
        out = out.withColumn("slot", F.coalesce("up_slot", "slot")).withColumn("at", F.coalesce("up", "at")).drop("child", "k", "up", "up_slot")
    return out.select("doc_id", "source", "block", F.when(F.col("at") == plan.root, F.col("slot")).alias("slot"), "position")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """All documents, all columns, in the order of the schedule: by slot over parts, sorted within each."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # repeated rows of one doc_id share the first one's slot, so the join keeps each row once
    key, at = f"k{uuid.uuid4().hex}", f"p{uuid.uuid4().hex}"  # no columns of docs are called so
    slot = schedule(docs, weights, block, frame).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct(F.coalesce("slot", F.lit(2**62)).alias("s"), F.col("position").alias("p"))).alias(at))
    joined = docs.join(slot, docs["doc_id"].eqNullSafe(slot[key]), "left")
    # without a slot all documents tie: a hash spreads them
    place = [f"{at}.s", f"{at}.p", F.xxhash64(F.col(key))]
    ordered = joined.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    return ordered.select(*[docs[c] for c in docs.columns])


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""k-means: seeds drawn by squared distance in distributed rounds, and restarts that share every scan of the points."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .written import materialize


class KMeans(NamedTuple):
    """assignment: key, centre, distance; costs: restart, step, cost; centres: centre, vector (the best restart's)."""

    assignment: DataFrame
    costs: DataFrame
    centres: DataFrame


def uniform(key: Column, *salt) -> Column:
    """A repeatable number in (0, 1) from 32 bits of a digest that any SQL engine has."""
    text = F.concat_ws(":", *[F.lit(str(s)) for s in salt], key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by differences: near points keep their digits."""
    out = np.empty((len(x), len(centres)))
    for k, c in enumerate(centres):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def seeds(points: DataFrame, k: int, restarts: int = 1, seed: int = 0) -> list[np.ndarray]:
    """For each restart k of the points: the first at random, each next one by squared distance to those before.

    A draw is a race: the point with the least -ln(u) / d2 has probability d2 / sum(d2).  So a round is one scan for
    all restarts, each task keeps its best point of each, and the same seed gives the same points however they are
    dealt.  Fewer distinct points than k give fewer seeds.  points: _k (unique), _v (arrays of one length).
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for turn in range(k):
        draws = F.array(*[uniform(F.col("_k"), seed, r, turn) for r in range(restarts)])

        def race(batches, chosen=chosen):
            best: dict = {}
            for rb in batches:
                if not rb.num_rows:
                    continue
                x, u, key = _matrix(rb.column("_v")), _matrix(rb.column("_u")), rb.column("_k").to_numpy()
                for r, have in enumerate(chosen):
                    d2 = _squares(x, np.array(have)).min(axis=1) if have else np.ones(len(x))
                    time = np.where(d2 > 0, -np.log(u[:, r]) / np.where(d2 > 0, d2, 1.0), np.inf)
                    at = int(np.lexsort((key, time))[0])
                    now = (float(time[at]), int(key[at]), x[at])
                    if np.isfinite(now[0]) and (r not in best or now[:2] < best[r][:2]):
                        best[r] = now
            rows = [(r, *best[r]) for r in best]
            yield pa.RecordBatch.from_pydict({"r": pa.array([b[0] for b in rows], pa.int32()), "t": pa.array([b[1] for b in rows], pa.float64()), "k": pa.array([b[2] for b in rows], pa.int64()), "v": pa.array([b[3] for b in rows], pa.list_(pa.float64()))})

        raced = points.withColumn("_u", draws).mapInArrow(race, "r int, t double, k long, v array<double>")
        for r in raced.groupBy("r").agg(F.min_by("v", F.struct("t", "k")).alias("v")).collect():  # a row a restart
            chosen[r["r"]].append(np.array(r["v"]))
    return [np.array(c) for c in chosen]


def _step(points: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """The centres' next places and, for each restart, the cost of this assignment around them; one scan for all."""

    def sums(batches):
        n = [np.zeros(len(c)) for c in centres]
        away = [np.zeros_like(c) for c in centres]  # summed differences from the old centre
        square = [np.zeros(len(c)) for c in centres]
        for rb in batches:
            if not rb.num_rows:
                continue
            x = _matrix(rb.column("_v"))
            for r, c in enumerate(centres):
                d2 = _squares(x, c)
                at = d2.argmin(axis=1)
                n[r] += np.bincount(at, minlength=len(c))
                square[r] += np.bincount(at, weights=d2[np.arange(len(x)), at], minlength=len(c))
                np.add.at(away[r], at, x - c[at])
        rows = [(r, k, float(n[r][k]), float(square[r][k]), away[r][k]) for r in range(len(centres)) for k in np.flatnonzero(n[r]).tolist()]
        yield pa.RecordBatch.from_pydict(
            {"r": pa.array([x[0] for x in rows], pa.int32()), "k": pa.array([x[1] for x in rows], pa.int32()), "n": pa.array([x[2] for x in rows], pa.float64()), "square": pa.array([x[3] for x in rows], pa.float64()), "away": pa.array([x[4] for x in rows], pa.list_(pa.float64()))}
        )

    parts = points.mapInArrow(sums, "r int, k int, n double, square double, away array<double>")
    width = centres[0].shape[1]
    total = parts.groupBy("r", "k").agg(F.sum("n").alias("n"), F.sum("square").alias("square"), *[F.sum(F.col("away")[i]).alias(f"a{i}") for i in range(width)])
    moved, cost = [c.copy() for c in centres], [0.0] * len(centres)
    for row in total.collect():  # restarts x centres rows
        shift = np.array([row[f"a{i}"] for i in range(width)]) / row["n"]
        moved[row["r"]][row["k"]] += shift
        cost[row["r"]] += max(0.0, row["square"] - row["n"] * float(shift @ shift))  # around the mean, not the old centre
    return moved, cost


def kmeans_full(points: DataFrame, key: str, vector: str, k: int, restarts: int = 1, iterations: int = 20, seed: int = 0) -> KMeans:
    """Lloyd's steps from drawn seeds; of the restarts the one of least final cost, ties to the earlier one.

    Each restart takes iterations + 1 steps: assign to the nearest centre (ties: the lower number), move centres to
    their means, note the cost around the moved centres.  assignment has each point's centre of the last step and its
    distance to the nearest centre as moved last.  A centre without points stays put.  Points with a null key or
    vector, a null or non-finite component or another length than most are left out; keys are unique integers.
    """
    fine = F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    held = points.where(F.col(key).isNotNull() & fine & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    lengths = held.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    held = materialize(held.where(F.size("_v") == (lengths[0]["n"] if lengths else 0)))
    spark = points.sparkSession
    schemas = "key long, centre int, distance double", "restart int, step int, cost double", "centre int, vector array<double>"
    if not lengths:
        return KMeans(*[spark.createDataFrame([], s) for s in schemas])
    before = now = seeds(held, k, restarts, seed)
    costs = []
    for step in range(iterations + 1):
        before, (now, cost) = now, _step(held, now)
        costs += [(r, step, c) for r, c in enumerate(cost)]
    best = min(range(restarts), key=lambda r: (cost[r], r))
    old, new = before[best], now[best]

    def assign(batches):
        for rb in batches:
            if rb.num_rows:
                x = _matrix(rb.column("_v"))
                yield pa.RecordBatch.from_arrays([rb.column("_k"), pa.array(_squares(x, old).argmin(axis=1), pa.int32()), pa.array(np.sqrt(_squares(x, new).min(axis=1)), pa.float64())], ["key", "centre", "distance"])

    assignment = held.mapInArrow(assign, schemas[0])
    return KMeans(assignment, spark.createDataFrame(costs, schemas[1]), spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(new)], schemas[2]))

"""Leading eigenpairs of a symmetric matrix of cells (i, j, v) by power iteration and deflation."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import uniform
from .written import materialize


def _times(cells: DataFrame, x: DataFrame) -> DataFrame:
    """(id, v): cells times a vector; the cells lie by j, so only the vector's shares are shuffled."""
    return cells.join(x.select(F.col("id").alias("j"), F.col("v").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v")).withColumnRenamed("i", "id")


def _start(ids: DataFrame, found: int, seed: int) -> tuple[DataFrame, float]:
    """(id, v, basis) with v a repeatable vector without the parts along the basis, and its length."""
    drawn = ids.withColumn("v", uniform(F.col("id"), seed, found))
    along = drawn.agg(*[F.sum(F.col("v") * F.col("basis")[b]) for b in range(found)], F.lit(0)).first()
    rest = F.col("v")
    for b in range(found):
        rest = rest - F.lit(float(along[b])) * F.col("basis")[b]
    drawn = drawn.withColumn("v", rest)
    return drawn, float(np.sqrt(drawn.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0))


def eigen_pairs(cells: DataFrame, k: int, most: int = 100, least: int = 5, eps: float = 1e-3, relative: bool = False, stride: int = 4, seed: int = 0) -> DataFrame:
    """(component, eigenvalue, residual, id, value): the k eigenvalues of largest size with unit vectors.

    For each pair the matrix, less those found, is applied until the length of A v - eigenvalue * v is at most
    eps (relative: eps times the eigenvalue's size), after `least` products at least; raises after `most`.  Vectors
    are held orthogonal to those found before, so rounding does not bring these back.  One job makes `stride`
    products and notes v, A v and the last product; the driver sees a few sums.  A sign makes a vector's sum of
    cubes positive.  cells has both (i, j) and (j, i); cells that are absent are 0.  A matrix of n ids gives n pairs
    at most, one of zeros pairs of 0; ids that are null and values that are null or NaN are left out.
    """
    spark = cells.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = cells.where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))).select("i", "j", F.col("v").cast("double").alias("v"))
    held = materialize(kept).repartition(parts, "j").persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks come back from the written cells
    try:
        ids = materialize(held.select(F.col("i").alias("id")).union(held.select("j")).distinct().withColumn("basis", F.array().cast("array<double>")))
        n, found = ids.count(), []
        while len(found) < min(k, n):
            state, length = _start(ids, len(found), seed)
            done = 0
            while True:
                unit = materialize(state.select("id", (F.col("v") / length if length > 0 else F.col("v")).alias("v"), "basis"))
                x, once = unit.select("id", "v"), None
                for _ in range(stride):
                    x = _times(held, x)
                    once = x if once is None else once
                noted = unit.join(once.select("id", F.col("v").alias("once")), "id", "left").join(x.select("id", F.col("v").alias("last")), "id", "left")
                noted = materialize(noted.na.fill(0.0, ["once", "last"]))
                v, a, z = F.col("v"), F.col("once"), F.col("last")
                dots = [F.sum(v * a), F.sum(a * a), F.sum(z * z)]
                for b in range(len(found)):
                    own = F.col("basis")[b]
                    dots += [F.sum(own * a), F.sum(own * z)]
                got = [float(g or 0.0) for g in noted.agg(*dots).first()]
                value, along_a, along_z = got[0], np.array(got[3::2]), np.array(got[4::2])
                # the basis is orthonormal, so what lies along it comes off as squares
                residual = float(np.sqrt(max(0.0, got[1] - value * value - along_a @ along_a)))
                done += stride
                if done >= least and residual <= eps * (abs(value) if relative else 1.0):
                    break
                if done >= most:
                    raise RuntimeError(f"eigenpair {len(found) + 1}: residual {residual:.3g} after {done} products")
                length = float(np.sqrt(max(0.0, got[2] - along_z @ along_z)))
                if length == 0:
                    break  # a null vector: its residual is the eigenvalue's own, 0
                rest = z
                for b in range(len(found)):
                    rest = rest - F.lit(float(along_z[b])) * F.col("basis")[b]
                state = noted.select("id", rest.alias("v"), "basis")
            found.append((value, residual))
            cubes = noted.agg(F.sum(v * v * v)).first()[0] or 0.0
            ids = noted.select("id", F.concat("basis", F.array(v * (1.0 if cubes >= 0 else -1.0))).alias("basis"))
        if not found:
            return spark.createDataFrame([], f"component int, eigenvalue double, residual double, id {dict(held.dtypes)['i']}, value double")
        pairs = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(value).alias("eigenvalue"), F.lit(residual).alias("residual"), F.col("basis")[c].alias("value")) for c, (value, residual) in enumerate(found)])
        return ids.select("id", F.explode(pairs).alias("p")).select("p.component", "p.eigenvalue", "p.residual", "id", "p.value")
    finally:
        held.unpersist()

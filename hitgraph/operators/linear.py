"""Principal components and truncated singular vectors from sparse cells (i, j, v); only small Gram matrices reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import materialize

#: Samples of a principal component analysis at most: their Gram matrix is collected.
MOST_SAMPLES = 1000


def centred_gram(cells: DataFrame) -> DataFrame:
    """(a, b, g): products of samples i over features j, each feature centred; features that lack a sample or a value are left out."""
    ok = cells.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    by = ok.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("s"), F.avg("v").alias("m"))
    n = F.broadcast(cells.agg(F.count_distinct("i").alias("n")))  # one row
    whole = by.crossJoin(n).where(F.size("s") == F.col("n")).select("j", F.transform("s", lambda x: F.struct(x["i"].alias("i"), (x["v"] - F.col("m")).alias("v"))).alias("s"))
    a = whole.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b"))
    return a.groupBy(F.col("a.i").alias("a"), F.col("b.i").alias("b")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("g"))


def _signs(u: np.ndarray) -> np.ndarray:
    """Each column's sign such that its largest entry is positive."""
    at = np.abs(u).argmax(0)
    return np.where(u[at, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def pca(cells: DataFrame, k: int | None = None) -> DataFrame:
    """(i, component, score, variance, share): samples on their components, centred and not scaled; samples are few (checked)."""
    gram = materialize(centred_gram(cells))
    names = [r[0] for r in gram.select("a").distinct().orderBy("a").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    schema = f"i {gram.schema['a'].dataType.simpleString()}, component long, score double, variance double, share double"
    if len(names) < 2:
        return cells.sparkSession.createDataFrame([], schema)
    at = {x: p for p, x in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in gram.collect():
        g[at[r["a"]], at[r["b"]]] = r["g"]
    value, vector = np.linalg.eigh(g)
    k = min(k or len(names) - 1, len(names) - 1)
    value, vector = np.maximum(value[::-1][:k], 0.0), vector[:, ::-1][:, :k]
    score = vector * _signs(vector) * np.sqrt(value)
    variance, total = value / (len(names) - 1), np.trace(g) / (len(names) - 1)
    rows = [(x, c + 1, float(score[p, c]), float(variance[c]), float(variance[c] / total) if total else 0.0) for x, p in at.items() for c in range(k)]
    return cells.sparkSession.createDataFrame(rows, schema)


def loadings(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """(j, component, loading) of each feature that every sample has: its centred values along the unit component."""
    ok = cells.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    n = scores.select("i").distinct().count()
    whole = ok.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).where(F.col("n") == n)
    unit = scores.groupBy("component").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length")).where("length > 0")
    axis = scores.join(unit, "component").select("i", "component", (F.col("score") / F.col("length") / F.col("length")).alias("w"))
    return ok.join(whole, "j").join(axis, "i").groupBy("j", "component").agg(F.sum((F.col("v") - F.col("m")) * F.col("w")).alias("loading"))


def _columns(k: int) -> list[str]:
    return [f"c{c}" for c in range(k)]


def _apply(cells: DataFrame, thin: DataFrame, k: int, over: str, to: str) -> DataFrame:
    """Cells times a thin matrix (id, c0 ..): summed over one index, rows by the other."""
    return cells.join(thin, cells[over] == thin["id"]).groupBy(cells[to].alias("id")).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in _columns(k)])


def _thin_gram(thin: DataFrame, k: int) -> np.ndarray:
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    row = thin.agg(*[F.coalesce(F.sum(F.col(f"c{a}") * F.col(f"c{b}")), F.lit(0.0)).alias(f"g{a}_{b}") for a, b in pairs]).first()
    g = np.zeros((k, k))
    for a, b in pairs:
        g[a, b] = g[b, a] = row[f"g{a}_{b}"]
    return g


def _times(thin: DataFrame, m: np.ndarray) -> DataFrame:
    """A thin matrix times a small one."""
    return thin.select("id", *[sum((F.col(f"c{a}") * float(m[a, c]) for a in range(m.shape[0])), F.lit(0.0)).alias(f"c{c}") for c in range(m.shape[1])])


def _orthogonal(thin: DataFrame, k: int) -> DataFrame:
    thin = materialize(thin)
    value, vector = np.linalg.eigh(_thin_gram(thin, k))
    scale = np.where(value > value.max() * 1e-13, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
    return _times(thin, vector * scale)


def _few_rows(cells: DataFrame, names: list, k: int) -> DataFrame:
    """svd_rows of a matrix with few rows, by their products, which the driver decomposes."""
    a, b = cells.select(F.col("i").alias("a"), "j", F.col("v").alias("va")), cells.select(F.col("i").alias("b"), "j", F.col("v").alias("vb"))
    at = {x: p for p, x in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in a.join(b, "j").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("g")).collect():
        g[at[r["a"]], at[r["b"]]] = r["g"]
    value, vector = np.linalg.eigh(g)
    k = min(k, len(names))
    sigma, vector = np.sqrt(np.maximum(value[::-1][:k], 0.0)), vector[:, ::-1][:, :k]
    image = vector * _signs(vector) * np.sqrt(sigma) if len(names) else vector
    rows = [(x, c + 1, float(image[p, c]), float(sigma[c])) for x, p in at.items() for c in range(k)]
    return cells.sparkSession.createDataFrame(rows, f"id {cells.schema['i'].dataType.simpleString()}, component long, value double, sigma double")


def _residuals(back: DataFrame, right: DataFrame, turn: np.ndarray, sigma: np.ndarray, k: int) -> np.ndarray:
    """Lengths of A'u - sigma v for the first k approximate triples: back has A'u, right times turn has v."""
    v = _times(right, turn[:, :k]).select("id", *[F.col(c).alias(f"v_{c}") for c in _columns(k)])
    met = back.select("id", *_columns(k)).join(v, "id", "full").na.fill(0.0)
    gap = lambda c: F.col(f"c{c}") - float(sigma[c]) * F.col(f"v_c{c}")
    row = met.agg(*[F.coalesce(F.sum(gap(c) * gap(c)), F.lit(0.0)).alias(f"r{c}") for c in range(k)]).first()
    return np.sqrt([row[f"r{c}"] for c in range(k)])


def svd_rows(cells: DataFrame, k: int = 10, extra: int = 6, rounds: int = 60, eps: float = 1e-9) -> DataFrame:
    """(id, component, value, sigma): rows of U * sqrt(sigma) of the k largest singular values, by subspace iteration.

    Each round is two joins of the cells with a thin matrix; the driver sees (k + extra)^2 numbers.  Rounds end when
    A'u differs from sigma v by eps * (the largest sigma) at most for each of the k triples; raises after so many `rounds`.  The
    start comes from a hash of the ids, so results repeat.  A component's sign makes its largest entry positive.  Up to
    MOST_SAMPLES rows give their products in one step instead, with equal results.
    """
    k0, wide = k, k + extra
    cells = materialize(cells.where("v <> 0").select("i", "j", F.col("v").cast("double").alias("v")))
    few = [r[0] for r in cells.select("i").distinct().orderBy("i").limit(MOST_SAMPLES + 1).collect()]
    if len(few) <= MOST_SAMPLES:
        return _few_rows(cells, few, k)
    ids = cells.select(F.col("j").alias("id")).distinct()
    start = [(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(2_000_003)) / 1_000_001.0 - 1.0).alias(f"c{c}") for c in range(wide)]
    right = _orthogonal(ids.select("id", *start), wide)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by i, so that sums over j need no shuffle and the other product moves the thin side alone; lost blocks come back from the written cells
    held = cells.repartition(parts, "i").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            right = materialize(right)
            image = materialize(_apply(held, right, wide, "j", "i"))
            value, vector = np.linalg.eigh(_thin_gram(image, wide))
            value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1]
            sigma = np.sqrt(value)
            unit = _times(image, vector * np.where(sigma > sigma[0] * 1e-12, 1 / np.maximum(sigma, 1e-300), 0.0))
            back = materialize(_apply(held, unit, wide, "i", "j"))
            if (_residuals(back, right, vector, sigma, k0) <= eps * sigma[0]).all():
                break
            right = _orthogonal(back, wide)
        else:
            raise RuntimeError(f"singular vectors: no convergence after {rounds} rounds")
    finally:
        held.unpersist()
    value, vector = value[:k0], vector[:, :k0]
    sigma = np.sqrt(value)
    out = _times(image, vector * np.where(sigma > 0, 1 / np.sqrt(np.maximum(sigma, 1e-300)), 0.0))
    big = out.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in _columns(k0)]).first()
    stack = F.explode(F.array(*[F.struct(F.lit(c + 1).cast("long").alias("component"), (F.col(f"c{c}") * (-1.0 if (big[f"c{c}"] or 0.0) < 0 else 1.0)).alias("value"), F.lit(float(sigma[c])).alias("sigma")) for c in range(k0)]))
    return out.select("id", stack.alias("s")).select("id", "s.component", "s.value", "s.sigma")

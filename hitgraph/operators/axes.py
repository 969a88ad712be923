"""Axis windows, ticks and scales, volcano tables, densities in two dimensions and level segments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plotdata import finite


def window(df: DataFrame, cols: list[str], margin: float = 0.05, log10: bool = False) -> DataFrame:
    """One row (lo, hi) over all given columns: the range widened by a margin of its width, whole powers on a log axis.

    Values that are not finite (on a log axis also those not positive) do not count; no value gives 0 to 1, equal ends
    part by 1.
    """
    usable = lambda c: finite(c) & (F.col(c) > 0) if log10 else finite(c)
    held = [F.when(usable(c), F.col(c).cast("double")) for c in cols]
    lo, hi = F.least(*map(F.min, held)) if len(held) > 1 else F.min(held[0]), F.greatest(*map(F.max, held)) if len(held) > 1 else F.max(held[0])
    r = df.agg(lo.alias("lo"), hi.alias("hi")).select(F.coalesce("lo", F.lit(1.0 if log10 else 0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    if log10:
        low, high = F.pow(F.lit(10.0), F.floor(F.log10("lo"))), F.pow(F.lit(10.0), F.ceil(F.log10("hi")))
    else:
        pad = margin * (F.col("hi") - F.col("lo"))
        low, high = F.col("lo") - pad, F.col("hi") + pad
    return r.select(low.alias("lo"), F.when(low == high, high + 1).otherwise(high).alias("hi"))


def scaled(v: Column, lo: float, hi: float, width: float = 1.0, log: float | None = None) -> Column:
    """A value's place on an axis of the given width; log: the base."""
    if log is None:
        return (v - lo) / (hi - lo) * width
    base = math.log(log)
    return (F.ln(v) / base - math.log(lo) / base) / (math.log(hi) / base - math.log(lo) / base) * width


# A step is 1, 2, 5 or 10 times a power of ten; the next one is taken from these bounds on.
_STEPS = ((1.5, 1), (3, 2), (7, 5))


def ticks(lo: float, hi: float, about: int = 5, minor: int = 4) -> tuple[list[float], list[float]]:
    """Major ticks at a round step from below lo to above hi, and the minor ones between them."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or hi <= lo:
        return ([lo], []) if math.isfinite(lo) else ([], [])
    raw = (hi - lo) / (about - 1)
    power = 10.0 ** math.floor(math.log10(raw))
    step = next((m for bound, m in _STEPS if raw / power < bound), 10) * power
    first, last = math.floor(lo / step), math.ceil(hi / step)
    every = range(first * minor, last * minor + 1)
    return [i * step for i in range(first, last + 1)], [i * step / minor for i in every if i % minor]


def volcano(df: DataFrame, label: str, effect: str, p: str, fdr: str, control: str = "NO_SITE", top: int = 5, named: list[str] | None = None, effect_cut: float = 0.0, fdr_cut: float = 0.05) -> DataFrame:
    """label, effect, y, hit, text: -log10 p with zeros at the least positive p.

    hit: up or down beyond both cuts, else ctrl for labels that match `control`, else a.  text: the label of the `top`
    smallest p of up and of down (ties by label) and of `named`, else empty.
    """
    low = F.broadcast(df.where(F.col(p) > 0).agg(F.min(p).alias("_least")))  # one row
    sure = F.col(fdr) < fdr_cut
    hit = F.when((F.col(effect) < -effect_cut) & sure, "down").when((F.col(effect) > effect_cut) & sure, "up").when(F.rlike(F.col(label), F.lit(control)), "ctrl").otherwise("a")
    rows = df.crossJoin(low).select(F.col(label).alias("label"), F.col(effect).alias("effect"), F.col(p).alias("_p"), (-F.log10(F.when(F.col(p) == 0, F.col("_least")).otherwise(F.col(p)))).alias("y"), hit.alias("hit"))
    side = lambda h: rows.where(F.col("hit") == h).select("label", F.col("_p").alias("p")).orderBy("p", "label").limit(top)
    shown = F.broadcast(side("up").union(side("down")).select(F.col("label").alias("_shown")).distinct())  # 2 * top rows
    out = rows.join(shown, rows["label"] == shown["_shown"], "left")
    return out.select("label", "effect", "y", "hit", F.when(F.col("_shown").isNotNull() | F.col("label").isin(named or []), F.col("label")).otherwise("").alias("text"))


def density2d(df: DataFrame, x: str, y: str, bandwidth: float = 0.1, points: int = 50) -> DataFrame:
    """(ix, iy, gx, gy, density) on an even grid: sum of exp(-distance^2 / (2 bandwidth)) / (rows * bandwidth^2).

    Batches add up to one matrix a task, so points^2 rows a task are shuffled, however many rows come in.
    """
    rows = df.where(finite(x) & finite(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    b = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not b[4]:
        return df.sparkSession.createDataFrame([], "ix long, iy long, gx double, gy double, density double")
    gx, gy, n = np.linspace(b[0], b[1], points), np.linspace(b[2], b[3], points), b[4]

    def part(frames):
        total = np.zeros((points, points))
        for f in frames:
            for at in range(0, len(f), 20_000):
                piece = f.iloc[at : at + 20_000]
                ex, ey = (np.exp(-0.5 * (piece[c].to_numpy()[:, None] - g) ** 2 / bandwidth) for c, g in (("x", gx), ("y", gy)))
                total += ex.T @ ey
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"ix": i.ravel(), "iy": j.ravel(), "s": total.ravel()})

    parts = rows.mapInPandas(part, "ix long, iy long, s double").groupBy("ix", "iy").agg(F.sum("s").alias("s"))
    place = lambda i, lo, hi: lo + F.col(i) * ((hi - lo) / (points - 1))
    return parts.select("ix", "iy", place("ix", b[0], b[1]).alias("gx"), place("iy", b[2], b[3]).alias("gy"), (F.col("s") / (n * bandwidth * bandwidth)).alias("density"))


def contour(grid: DataFrame, levels: list[float]) -> DataFrame:
    """(level, x0, y0, x1, y1): level segments of a grid (ix, iy, gx, gy, density).

    Each cell's four corners meet by windows over the grid; its two triangles are each crossed by a level in one segment
    or none, so no case is ambiguous.  Cells that lack a corner have none.
    """
    corner = F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("density").alias("z"), F.col("iy"))
    up = grid.select("ix", "iy", corner.alias("p"), F.lead(corner).over(Window.partitionBy("ix").orderBy("iy")).alias("q")).where("q.iy = iy + 1")
    right = Window.partitionBy("iy").orderBy("ix")
    cell = up.select("p", "q", F.lead("p").over(right).alias("r"), F.lead("q").over(right).alias("s"), "ix", F.lead("ix").over(right).alias("nx")).where("nx = ix + 1")
    three = cell.select(F.explode(F.array(F.array("p", "q", "s"), F.array("p", "r", "s"))).alias("t"))
    three = three.select("t", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))

    def crossing(a: int, b: int) -> Column:
        p, q, v = F.col("t")[a], F.col("t")[b], F.col("level")
        share = (v - p["z"]) / (q["z"] - p["z"])
        point = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
        return F.when((p["z"] < v) != (q["z"] < v), point)

    ends = three.select("level", F.filter(F.array(crossing(0, 1), crossing(1, 2), crossing(0, 2)), lambda e: e.isNotNull()).alias("e")).where(F.size("e") == 2)
    return ends.select("level", *[F.col("e")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")])

"""Colour scales and the relations that plots draw: Column expressions and tables, no pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .plotdata import finite

Colour = tuple[int, int, int]


def _rgba(r: Column, g: Column, b: Column, v: Column, a: Column | None = None) -> Column:
    """A struct of integers; a value that is NULL or NaN is transparent."""
    absent = v.isNull() | F.isnan(v)
    part = lambda x: F.when(absent, F.lit(0)).otherwise(x).cast("int")
    return F.struct(part(r).alias("r"), part(g).alias("g"), part(b).alias("b"), part(F.lit(255) if a is None else a).alias("a"))


def _hue(t: Column, v: Column) -> Column:
    """Full saturation, half lightness: t = 0 is blue, 1 is red."""
    h = (F.lit(1.0) - t) * 4.0
    clip = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255)
    return _rgba(clip(F.abs(h - 3.0) - 1.0), clip(2.0 - F.abs(h - 2.0)), clip(2.0 - F.abs(h - 4.0)), v)


def heat(v: Column, lo: float = 0.0, hi: float = 1.0, mid: float | None = None) -> Column:
    """Blue at lo over green at the middle to red at hi; values beyond are clamped."""
    m = (lo + hi) / 2 if mid is None else mid
    t = F.when(v > hi, 1.0).when(v < lo, 0.0).when(v > m, (v - m) * 0.5 / (hi - m) + 0.5).otherwise((v - lo) * 0.5 / (m - lo))
    return _hue(t, v)


def log_heat(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    t = F.when(v > hi, 1.0).when(v < lo, 0.0).otherwise(F.log10(v - lo + 1.0) / F.log10(F.lit(hi - lo + 1.0)))
    return _hue(t, v)


def gray(v: Column, lo: float = 0.0, hi: float = 1.0, white: int = 255, clear_below: bool = False) -> Column:
    t = F.when(v > hi, 1.0).when(v < lo, 0.0).otherwise((v - lo) / (hi - lo))
    level = white - F.floor(t * white)
    return _rgba(level, level, level, v, F.when(v < lo, 0).otherwise(255) if clear_below else None)


def diverging(v: Column, low: Colour, middle: Colour, high: Colour, lo: float = 0.0, hi: float = 1.0, mid: float | None = None) -> Column:
    """Interpolated in RGB from the middle colour towards one end or the other."""
    m = (lo + hi) / 2 if mid is None else mid
    up = F.least((v - m) / (hi - m), F.lit(1.0))
    down = F.least((m - v) / (m - lo), F.lit(1.0))
    part = lambda k: F.when(v > m, F.floor(middle[k] + up * (high[k] - middle[k]))).otherwise(F.floor(middle[k] + down * (low[k] - middle[k])))
    return _rgba(part(0), part(1), part(2), v)


def red_blue(v: Column, lo: float = 0.0, hi: float = 1.0, mid: float | None = None, white: int = 255) -> Column:
    return diverging(v, (0, 0, 255), (white, white, white), (255, 0, 0), lo, hi, mid)


def manual(v: Column, colours: dict, default: Colour) -> Column:
    """A colour by exact value."""
    def part(k: int) -> Column:
        out = F.lit(default[k])
        for value, c in colours.items():
            out = F.when(v == value, c[k]).otherwise(out)
        return out

    return _rgba(part(0), part(1), part(2), v)


def polynomial(df: DataFrame, coefficients: str, lo: float, hi: float, samples: int = 50) -> DataFrame:
    """df with sample, x, y: the polynomial (constant first) at even places from lo, by Horner's rule."""
    at = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("x", lo + F.col("sample") * (hi - lo) / samples)
    return at.withColumn("y", F.aggregate(F.reverse(F.col(coefficients)), F.lit(0.0), lambda s, c: c + F.col("x") * s))


def _turned(c: Column, kind: str) -> Column:
    """A value whose ascending order is the descending order of c."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.bitwise_not(c.cast("long"))  # unlike -x never out of range
    if kind in ("float", "double") or kind.startswith("decimal"):
        return -c
    if kind == "boolean":
        return ~c
    if kind == "date":
        return F.bitwise_not(F.unix_date(c))
    if kind.startswith("timestamp"):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    if kind in ("string", "binary"):  # digits of the bytes turned round; the end sorts after all of them
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    raise ValueError(f"no descending order of {kind}")


def places(df: DataFrame, group: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """df with ordinal (from 0) by group in the order of the given columns, the last of which makes it unique.

    One range shuffle; no task holds a group.  descending turns the first column round; NULLs of it come last.  Columns
    keep their types, so long whole numbers and strings are in their own order.
    """
    first = F.col(order[0])
    kind = df.schema[order[0]].dataType.simpleString()
    key = _turned(first, kind) if descending else first
    # fields by number, as columns may have any name; each value after a flag, which puts NULLs last
    fields = [f for k in (key, *(F.col(c) for c in order[1:])) for f in (k.isNull(), k)]
    keyed = df.withColumn("_o", F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]))
    return ranks.with_rank(keyed.withColumn("_g", F.lit(0)), [*group, "_g"], "_o").withColumn("ordinal", F.col("rank") - 1).drop("_o", "_g", "rank", "group_size")


def bar_extent(df: DataFrame, x: str, width: str | float) -> DataFrame:
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    return df.where(finite(x)).agg(F.min(F.col(x) - w).alias("lo"), F.max(F.col(x) + w).alias("hi"))


def line_segments(df: DataFrame, series: list[str], order: str, x: str, y: str, window: tuple[float, float, float, float]) -> DataFrame:
    """series, x0, y0, x1, y1: each kept point joined to the kept one before it in its series; points outside are skipped."""
    x0, x1, y0, y1 = window
    kept = df.where(finite(x) & finite(y) & F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    w = Window.partitionBy(*series).orderBy(order)
    return kept.select(*series, F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1")).where("x0 is not null")


def segment_endpoints(edges: DataFrame, nodes: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """edges (u, v, ...) with x1, y1, x2, y2 of their nodes; edges to unknown nodes drop."""
    end = lambda e, i: nodes.select(F.col(key).alias(e), F.col(x).alias(f"x{i}"), F.col(y).alias(f"y{i}"))
    return edges.join(end("u", 1), "u").join(end("v", 2), "v")


def radar(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, axis, share: each column scaled by its own range to 0..1; a constant column gives 0."""
    span = F.broadcast(df.agg(*[F.min(c).cast("double").alias(f"_lo{i}") for i, c in enumerate(cols)], *[F.max(c).cast("double").alias(f"_hi{i}") for i, c in enumerate(cols)]))  # one row
    share = lambda i, c: F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), (F.col(c) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).when(F.col(c).isNotNull(), 0.0)
    each = F.array(*[F.struct(F.lit(c).alias("axis"), share(i, c).alias("share")) for i, c in enumerate(cols)])
    return df.crossJoin(span).select(key, F.explode(each).alias("s")).select(key, "s.axis", "s.share")


def raster(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """x (column's ordinal), y (row's ordinal by key), z in long form; key is numeric and unique."""
    placed = places(df.select(key, *cols), [], [key])
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("x"), F.col(c).cast("double").alias("z")) for i, c in enumerate(cols)])
    return placed.select(F.col("ordinal").alias("y"), F.explode(each).alias("s")).select("s.x", "y", "s.z")


def jitter_strength(df: DataFrame, boxes: DataFrame, group: list[str], x: str, width: float, decay: float) -> DataFrame:
    """df with strength: width * exp(decay * |x - median| / (q3 - q1)) from the boxes' columns; NULL if the quartiles meet."""
    b = boxes.select(*group, "q1", "median", "q3")
    spread = F.col("q3") - F.col("q1")
    s = F.when(spread > 0, width * F.exp(decay * F.abs(F.col(x) - F.col("median")) / spread))
    return df.join(b, group).withColumn("strength", s).drop("q1", "median", "q3")


def swarm_density(df: DataFrame, group: list[str], x: str, least: int = 10) -> DataFrame:
    """group, x, density: the Gaussian density of the group at each of its distinct values; bandwidth sd / 3 (1 if that is none).

    Groups of fewer than `least` rows give 0.  Equal values are counted first, and values in different blocks of 39
    bandwidths' width never meet but for neighbours: what lies further off adds less than the smallest double.
    """
    ok = df.where(finite(x)).select(*group, F.col(x).cast("double").alias("x"))
    stat = ok.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("x").alias("_sd"))
    stat = stat.select(*group, "_n", F.when(F.col("_sd") > 0, F.col("_sd") / 3).otherwise(1.0).alias("_h"))
    v = ok.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("_c")).join(stat, group)
    v = v.withColumn("_b", F.floor(F.col("x") / (F.col("_h") * 39)))
    wide = v.select(*group, F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"), F.col("x").alias("_x"), F.col("_c").alias("_k"))
    z = (F.col("x") - F.col("_x")) / F.col("_h")
    s = v.join(wide, [*group, "_b"]).groupBy(*group, "x", "_n", "_h").agg(F.sum(F.col("_k") * F.exp(-0.5 * z * z)).alias("_s"))
    return s.select(*group, "x", F.when(F.col("_n") >= least, F.col("_s") / (F.col("_n") * F.col("_h") * 2.5066282746310002)).otherwise(0.0).alias("density"))

"""Leading eigenpairs of a matrix of products of rows, which is never formed: short recurrences over packed rows."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import uniform
from .written import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Ids of a block of a vector, cells of a pack, about, and vectors of a recurrence before it starts again.
BLOCK, CELLS, VECTORS = 1 << 14, 1 << 22, 64
#: A vector's block beside what the recurrence needs to go on: the vector, the one before, those found, the product.
_STATE = "b int, q binary, prev binary, basis array<binary>, y binary, dots array<double>"
_HELD = "p int, b int, n int, one binary, two binary, three binary"


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _floats(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer())


def _pack(rows: pa.Table) -> pa.Table:
    """A pack's cells as three arrays: place of the row, place of the id in the pack's own list, value."""
    r, i = (rows[c].combine_chunks().dictionary_encode() for c in ("r", "i"))
    arrays = _bytes(r.indices.to_numpy().astype(np.int32), i.indices.to_numpy().astype(np.int32), rows["v"].to_numpy())
    whole = pa.ListArray.from_arrays(pa.array([0, len(i.dictionary)], pa.int32()), i.dictionary)
    return pa.table({"p": rows["p"][:1], "n": pa.array([len(r.dictionary)], pa.int32()), **dict(zip(("one", "two", "three"), arrays)), "ids": whole})


def _places(rows: pa.Table) -> pa.Table:
    """Where a pack's ids of one block lie: in the pack's list and in the block."""
    pos, at = _bytes(*(rows[c].to_numpy().astype(np.int32) for c in ("pos", "at")))
    return pa.table({"p": rows["p"][:1], "b": rows["b"][:1], "n": rows["n"][:1], "one": pos, "two": at, "three": pa.nulls(1, pa.binary())})


def _product(held: pa.Table, sent: pa.Table) -> pa.Table:
    """A pack's share of the product, by blocks: its rows times the vector, and that times its rows again."""
    blocks = {b: _floats(d) for b, d in zip(sent["b"].to_pylist(), sent["q"])}
    places = []
    for b, n, one, two, three in zip(held["b"].to_pylist(), held["n"].to_pylist(), held["one"], held["two"], held["three"]):
        one, two = np.frombuffer(one.as_buffer(), np.int32), np.frombuffer(two.as_buffer(), np.int32)
        if b is None:
            count, r, i, v = n, one, two, _floats(three)
        else:
            places.append((b, n, one, two))
    x = np.zeros(sum(len(p[2]) for p in places))
    for b, _, pos, at in places:
        x[pos] = blocks[b][at]
    y = np.bincount(i, v * np.bincount(r, v * x[i], count)[r], len(x))
    out = []
    for _, n, pos, at in places:
        part = np.zeros(n)
        part[at] = y[pos]
        out.append(part.tobytes())
    return pa.table({"b": pa.array([p[0] for p in places], pa.int32()), "y": pa.array(out, pa.binary())})


def _add(rows: pa.Table) -> pa.Table:
    """A block of the product beside the vector's, and its shares of the cubes' sum and of the products among q, the one before, y and those found."""
    y = q = None
    for at, part in enumerate(rows["y"]):
        if part.is_valid:
            y = _floats(part) if y is None else y + _floats(part)
        else:
            own, q = rows.slice(at, 1), _floats(rows["q"][at])
    y = np.zeros(len(q)) if y is None else y
    basis = [_floats(x) for x in own["basis"][0].values or []]
    prev = _floats(own["prev"][0])
    dots = [(q**3).sum(), q @ y, y @ y, q @ q, prev @ y, prev @ q, prev @ prev, *[x @ y for x in basis], *[x @ q for x in basis]]
    return pa.table({**{c: own[c] for c in ("b", "q", "prev", "basis")}, "y": _bytes(y)[0], "dots": pa.array([dots], pa.list_(pa.float64()))})


def _moved(frame: DataFrame, of, fresh: bool = False) -> DataFrame:
    """Each block's row with the vector that `of` makes from (q, prev, basis, y), and q, or zeros, as the one before."""

    def kernel(batches):
        for rb in batches:
            t = pa.Table.from_batches([rb])
            made = [of(_floats(q), _floats(prev), [_floats(x) for x in basis.values or []], _floats(y)).tobytes() for q, prev, basis, y in zip(t["q"], t["prev"], t["basis"], t["y"])]
            before = pa.array([bytes(len(x)) for x in made], pa.binary()) if fresh else t["q"]
            yield from pa.table({"b": t["b"], "q": pa.array(made, pa.binary()), "prev": before, "basis": t["basis"]}).combine_chunks().to_batches()

    return frame.mapInArrow(kernel, "b int, q binary, prev binary, basis array<binary>")


def _sums(frame: DataFrame, of, count: int) -> np.ndarray:
    """Sums over the blocks of the numbers that `of` makes from (q, basis, y)."""

    def kernel(batches):
        for rb in batches:
            made = [list(of(_floats(q), [_floats(x) for x in basis.values or []], _floats(y))) for q, basis, y in zip(rb.column("q"), rb.column("basis"), rb.column("y"))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64()))], ["dots"])

    return np.array(frame.mapInArrow(kernel, "dots array<double>").agg(*[F.sum(F.col("dots")[d]) for d in range(count)]).first(), float)


def gram_pairs(rows: DataFrame, k: int, most: int = 100, least: int = 5, eps: float = 1e-3, relative: bool = False, stride: int = 4, seed: int = 0, vectors: int = VECTORS, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(component, eigenvalue, residual, id, value): the k largest eigenvalues of A with unit vectors.

    rows: (r, i, v), a cell each; A[i, j] is the sum over r of v[r, i] * v[r, j], as eigen.eigen_pairs takes it in cells.
    A row of A's factor lies in one pack, so a product A q is one visit to each pack; blocks of q and of its shares move.
    Vectors come from Lanczos' recurrence, held orthogonal to those found; every `stride` products, and after `vectors` at
    most, the best vector of their span is tried.  It is taken if the length of A v - eigenvalue * v is at most eps
    (relative: eps times the eigenvalue), else the recurrence starts again from it; raises after `most` products.  The
    driver sees a few sums a product.  A sign makes a vector's sum of cubes positive.  n ids give n pairs at most.  Rows
    and ids that are null and values that are null or NaN are left out.
    """
    spark = rows.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    v = F.col("v").cast("double")
    kept = materialize(rows.where(F.col("r").isNotNull() & F.col("i").isNotNull() & v.isNotNull() & ~F.isnan(v)).select("r", "i", v.alias("v")))
    kind = dict(kept.dtypes)["i"]
    ids = materialize(kept.select(F.col("i").alias("id")).distinct())
    n = ids.count()
    if min(k, n) < 1:
        return spark.createDataFrame([], f"component int, eigenvalue double, residual double, id {kind}, value double")
    names = materialize(ids.repartitionByRange(-(-n // block), "id").withColumn("_at", F.monotonically_increasing_id()))
    names = names.select("id", F.shiftright("_at", 33).cast("int").alias("b"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("at"))
    packs = max(2 * parts, -(-kept.count() // cells))
    dealt = kept.withColumn("p", F.pmod(F.xxhash64("r"), F.lit(packs)).cast("int"))
    packed = materialize(dealt.groupBy("p").applyInArrow(_pack, f"p int, n int, one binary, two binary, three binary, ids array<{kind}>"))
    size = names.groupBy("b").agg(F.count(F.lit(1)).cast("int").alias("n"))  # a row a block
    listed = packed.select("p", F.posexplode("ids").alias("pos", "id")).join(names, "id").join(F.broadcast(size), "b")
    places = materialize(listed.select("p", "b", "n", "pos", "at").groupBy("p", "b").applyInArrow(_places, _HELD))
    held = packed.select("p", F.lit(None).cast("int").alias("b"), "n", "one", "two", "three").unionByName(places)
    held = held.repartition(parts, "p").sortWithinPartitions("p").persist(StorageLevel.MEMORY_AND_DISK)
    index = materialize(places.select("p", "b").repartition(1))  # a row a pack and block

    def times(state: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """(the blocks with their product, its sums) of blocks (b, q, prev, basis)."""
        sent = F.broadcast(index).join(state.select("b", "q"), "b").select("p", "b", "q")
        share = held.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(_product, "b int, y binary")
        t = materialize(state.withColumn("y", F.lit(None).cast("binary")).unionByName(share, allowMissingColumns=True).groupBy("b").applyInArrow(_add, _STATE))
        return t, np.array(t.agg(*[F.sum(F.col("dots")[d]) for d in range(7 + 2 * len(found))]).first(), float)

    def unit(state: DataFrame) -> DataFrame:
        """Blocks (b, q, basis) less what lies along the basis, of length 1."""
        whole = materialize(state.select("b", "q", F.col("q").alias("prev"), "basis", F.col("q").alias("y")))
        got = _sums(whole, lambda q, basis, y: [q @ q, *[x @ q for x in basis]], 1 + len(found))
        along, length = got[1:], float(np.sqrt(max(0.0, got[0] - got[1:] @ got[1:]))) or 1.0
        return _moved(whole, lambda q, prev, basis, y: (q - sum(a * x for a, x in zip(along, basis))) / length, fresh=True)

    def fill(t: pa.Table) -> pa.Table:
        x = np.empty(t.num_rows)
        x[t["at"].to_numpy()] = t["v"].to_numpy()
        return pa.table({"b": t["b"][:1], "q": _bytes(x)[0]})

    def weighed(t: pa.Table) -> pa.Table:
        return pa.table({"b": t["b"][:1], "q": _bytes(sum(_floats(q) * s for q, s in zip(t["q"], t["s"].to_pylist())))[0]})

    def onward(alpha: float, back: float, along: np.ndarray, beta: float):
        return lambda q, prev, basis, y: (y - alpha * q - back * prev - sum(a * x for a, x in zip(along, basis))) / beta

    def values(batches):
        for rb in batches:
            for b, basis in zip(rb.column("b").to_pylist(), rb.column("basis")):
                each = [_floats(x) for x in basis.values]
                count = len(each[0])
                flat = pa.array(np.column_stack(each).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, b, np.int32)), pa.array(np.arange(count, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * len(each)), flat)], ["b", "at", "basis"])

    try:
        found: list[tuple[float, float]] = []
        basis = names.select("b").distinct().withColumn("basis", F.array().cast("array<binary>"))
        while len(found) < min(k, n):
            drawn = names.select("b", "at", uniform(F.col("id"), seed, len(found)).alias("v")).groupBy("b").applyInArrow(fill, "b int, q binary")
            t, sums = times(unit(drawn.join(basis, "b")))
            done = 1
            while True:
                diagonal, beside, tables, left = [], [], [], np.zeros(len(found))
                while True:
                    tables.append(t)
                    qy, yy, qq, py, pq, pp = sums[1:7]
                    along, own = np.split(sums[7:], 2)
                    alpha, back = qy, beside[-1] if beside else 0.0
                    diagonal.append(alpha)
                    off = along - alpha * own - back * left  # with rounding's share of the basis, which would grow
                    rest = yy + alpha**2 * qq + back**2 * pp - 2 * alpha * qy - 2 * back * py + 2 * alpha * back * pq
                    beta = float(np.sqrt(max(0.0, rest - off @ off)))
                    ended = beta <= 1e-7 * np.sqrt(yy)
                    last = ended or len(tables) >= vectors or done + 1 >= most
                    if last or len(tables) % stride == 0:
                        size_, mixed = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
                        if last or beta * abs(mixed[-1, -1]) <= eps * (abs(size_[-1]) if relative else 1.0) / 2:
                            break
                    q = _moved(t, onward(alpha, back, off, beta))
                    left = own
                    beside.append(beta)
                    t, sums = times(q)
                    done += 1
                union = None
                for each, s in zip(tables, mixed[:, -1]):
                    one = each.select("b", "q", F.lit(float(s)).alias("s"))
                    union = one if union is None else union.unionByName(one)
                t, sums = times(unit(union.groupBy("b").applyInArrow(weighed, "b int, q binary").join(basis, "b")))
                done += 1
                value, along = float(sums[1]), sums[7 : 7 + len(found)]
                apart = lambda q, basis, y: [((y - value * q - sum(a * x for a, x in zip(along, basis))) ** 2).sum()]  # noqa: E731, B023
                residual = float(np.sqrt(_sums(t, apart, 1)[0]))
                if (done >= least or ended) and residual <= eps * (abs(value) if relative else 1.0):
                    break
                if done >= most:
                    raise RuntimeError(f"eigenpair {len(found) + 1}: residual {residual:.3g} after {done} products")
            found.append((value, residual))
            sign = 1.0 if sums[0] >= 0 else -1.0
            taken = _moved(t, lambda q, prev, basis, y: q * sign)
            basis = materialize(taken.select("b", F.concat("basis", F.array("q")).alias("basis")))
        pairs = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(value).alias("eigenvalue"), F.lit(residual).alias("residual"), F.col("basis")[c].alias("value")) for c, (value, residual) in enumerate(found)])
        each = basis.mapInArrow(values, "b int, at int, basis array<double>").join(names, ["b", "at"])
        return each.select("id", F.explode(pairs).alias("p")).select("p.component", "p.eigenvalue", "p.residual", "id", "p.value")
    finally:
        held.unpersist()

"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points in order.  The inverted lists are kept by combinations of
`shared` pivots: two vectors stand in one list if and only if they have that many of their `near` nearest pivots in
common.  Vectors with the same first two pivots are one cell; lists hold cells, so a crowd of copies is a few entries
in a list, not its square.  Cells that meet are verified by exact cosines, block by block, or at once where their
balls settle every pair by the triangle inequality.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, util

#: Reference points, how many of the nearest describe a vector, how many two vectors must share to be compared.
PIVOTS, NEAR, SHARED = 1024, 8, 3
#: Rows, of the smallest hashes of the id, from which the reference points are taken.
SAMPLE = 4096
#: No two reference points have a greater cosine: copies in the sample give one.
APART = 0.9
#: Rows of a side of a comparison; larger cells are split.
BLOCK = 512
#: Cells of more rows get a ball, which may settle whole pairs of cells.
CROWD = 64
#: Pairs of cells held before they are made distinct.
HELD = 1 << 20


def vectors(column: pa.Array) -> np.ndarray:
    """(rows, length) of a list column whose rows have one length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reference_points(sample: np.ndarray, n: int, length: int, seed: int = 5) -> np.ndarray:
    """n directions: sampled vectors that lie apart, then random ones."""
    rng = np.random.default_rng(seed)
    out, have = np.zeros((n, length)), 0
    for v in sample:
        if have < n and not (out[:have] @ v > APART).any():
            out[have] = v
            have += 1
    if have < n:
        out[have:] = unit(rng.normal(size=(n - have, length)))
    return out


def nearest(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest points, nearest first, ties by number."""
    s = x @ points.T
    if k < s.shape[1]:
        top = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
    else:
        top = np.tile(np.arange(s.shape[1]), (len(x), 1))
    order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def usable(vector) -> object:
    """Neither null nor empty nor zero, and every component finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(rows: DataFrame, pivots: int, near: int, seed: int = 5) -> DataFrame:
    """(rid, vec_id, vec, points, cell) of each row: its nearest pivots, and the cell that its first two name; written."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    known: dict[int, np.ndarray] = {}
    for length in set(first["vec"].combine_chunks().value_lengths().to_pylist()) if first.num_rows else ():
        column = first["vec"].combine_chunks()
        mine = column.filter(pc.equal(pc.list_value_length(column), length))
        known[length] = reference_points(unit(vectors(mine)), pivots, length, seed)

    def kernel(batches):
        for rb in batches:
            lengths = pc.list_value_length(rb.column("vec")).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                part = rb.filter(pa.array(lengths == length))
                if length not in known:  # a length that the sample lacks
                    known[length] = reference_points(np.zeros((0, length)), pivots, length, seed)
                x = unit(vectors(part.column("vec")))
                p = nearest(x, known[length], min(near, pivots))
                cell = (np.int64(length) * pivots + p[:, 0]) * pivots + p[:, min(1, p.shape[1] - 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in p.astype("<i4")], pa.binary()), pa.array(cell, pa.int64())], ["vec_id", "vec", "points", "cell"]
                )

    out = rows.mapInArrow(kernel, "vec_id long, vec binary, points binary, cell long")
    return util.persist(out.withColumn("rid", F.monotonically_increasing_id()))


def meeting(indexed: DataFrame, shared: int) -> DataFrame:
    """Distinct pairs (a < b) of cells that stand in one inverted list."""
    parts = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            cell = rb.column("cell").to_numpy()
            wide = pc.binary_length(rb.column("points")).to_numpy(zero_copy_only=False)[0] // 4
            points = np.frombuffer(b"".join(rb.column("points").to_pylist()), "<i4").reshape(-1, wide).astype(np.uint64)
            points.sort(axis=1)
            length = rb.column("len").to_numpy().astype(np.uint64)  # lists of unlike lengths never meet
            keys = []
            for combo in combinations(range(wide), min(shared, wide)):
                h = length.copy()
                for c in combo:
                    h = util.mix(h * np.uint64(0x9FB21C651E98DF25) + points[:, c] + np.uint64(1))
                keys.append(h)
            held = pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "cell": np.tile(cell, len(keys))}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    lists = indexed.select("cell", "points", (F.length("vec") / 8).cast("long").alias("len")).mapInArrow(post, "key long, cell long")
    lists = lists.repartition(parts, "key").sortWithinPartitions("key", "cell")

    def pairs(key: np.ndarray, cell: np.ndarray):
        end = np.searchsorted(key, key, side="right")
        at, step = np.arange(len(key)), 1
        found, n = [], 0
        while len(at):
            at = at[at + step < end[at]]
            found.append(pd.DataFrame({"a": cell[at], "b": cell[at + step]}))
            n += len(at)
            step += 1
            if n >= HELD:
                found = [pd.concat(found).drop_duplicates()]
                n = 0
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    def pair_up(batches):
        key = cell = np.zeros(0, np.int64)
        held, size = [], 0
        for rb in batches:
            key, cell = np.concatenate([key, rb.column("key").to_numpy()]), np.concatenate([cell, rb.column("cell").to_numpy()])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            key, cell = key[new], cell[new]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            held.append(pairs(key[:whole], cell[:whole]))
            size += len(held[-1])
            key, cell = key[whole:], cell[whole:]
            if size >= HELD:
                yield pa.RecordBatch.from_pandas(pd.concat(held).drop_duplicates(), preserve_index=False)
                held, size = [], 0
        held.append(pairs(key, cell))
        yield pa.RecordBatch.from_pandas(pd.concat(held).drop_duplicates(), preserve_index=False)

    return lists.mapInArrow(pair_up, "a long, b long").distinct()


def balls(indexed: DataFrame, crowds: DataFrame) -> DataFrame:
    """(cell, centre, radius) of the cells in `crowds`; radius in radians, from the mean direction."""
    mine = indexed.join(crowds.select("cell"), "cell").select("cell", "vec")

    def by_cell(cell: np.ndarray):
        order = np.argsort(cell, kind="stable")
        names, start = np.unique(cell[order], return_index=True)
        return order, names, [*start.tolist(), len(cell)]

    def sums(batches):
        for rb in batches:
            order, names, at = by_cell(rb.column("cell").to_numpy())
            vec = rb.column("vec").to_pylist()
            total = [np.sum([np.frombuffer(vec[i]) for i in order[a:b]], axis=0).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(total, pa.binary())], ["cell", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in table["total"].to_pylist()], axis=0)
        length = np.sqrt((total * total).sum())
        total = total / length if length > 1e-9 else np.eye(1, len(total))[0]
        return pa.table({"cell": table["cell"][:1], "centre": pa.array([total.tobytes()], pa.binary())})

    # a row for each batch and cell: a cell's group has one row for some thousands of its vectors
    centres = util.persist(mine.mapInArrow(sums, "cell long, total binary").groupBy("cell").applyInArrow(add, "cell long, centre binary"))

    def reach(batches):
        for rb in batches:
            x, c = (np.frombuffer(b"".join(rb.column(k).to_pylist())) for k in ("vec", "centre"))
            n = [len(v) // 8 for v in rb.column("vec").to_pylist()]
            if n:
                angle = np.arccos(np.clip(np.add.reduceat(x * c, np.concatenate([[0], np.cumsum(n)[:-1]])), -1, 1))
                yield pa.RecordBatch.from_arrays([rb.column("cell"), pa.array(angle, pa.float64())], ["cell", "angle"])

    far = mine.join(centres, "cell").select("cell", "vec", "centre").mapInArrow(reach, "cell long, angle double")
    return util.persist(centres.join(far.groupBy("cell").agg(F.max("angle").alias("radius")), "cell"))


def settled(pairs: DataFrame, ball: DataFrame, cosine: float) -> DataFrame:
    """pairs with `verdict`: 1 if balls show that all their members link, -1 if none can, 0 otherwise."""
    a = ball.select(F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    b = ball.select(F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    limit = float(np.arccos(cosine))

    def judge(batches):
        for rb in batches:
            ca, cb = rb.column("ca").to_pylist(), rb.column("cb").to_pylist()
            ra, rr = rb.column("ra").to_numpy(zero_copy_only=False), rb.column("rb").to_numpy(zero_copy_only=False)
            out = np.zeros(rb.num_rows, np.int32)
            for i in range(rb.num_rows):
                if ca[i] is not None and cb[i] is not None and len(ca[i]) == len(cb[i]):
                    angle = float(np.arccos(np.clip(np.frombuffer(ca[i]) @ np.frombuffer(cb[i]), -1, 1)))
                    out[i] = 1 if angle + ra[i] + rr[i] < limit - 1e-6 else -1 if angle - ra[i] - rr[i] > limit + 1e-6 else 0
            yield pa.RecordBatch.from_arrays([rb.column("a"), rb.column("b"), pa.array(out, pa.int32())], ["a", "b", "verdict"])

    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "ca", "ra", "cb", "rb").mapInArrow(judge, "a long, b long, verdict int")


def _tile(ids: np.ndarray, x: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, smallest id that it reaches inside the tile); side 2 is a block against itself."""
    if side[0] == 2:
        one = two = slice(0, len(ids))
        link = x @ x.T >= cosine
        np.fill_diagonal(link, False)
        n = link.sum(axis=1)
    else:
        cut = int(np.searchsorted(side, 1))
        one, two = slice(0, cut), slice(cut, len(ids))
        link = x[one] @ x[two].T >= cosine
        n = np.concatenate([link.sum(axis=1), link.sum(axis=0)])
    low = ids.copy()
    most = np.iinfo(np.int64).max
    while link.any():
        new = low.copy()
        new[one] = np.minimum(new[one], np.where(link, low[two][None, :], most).min(axis=1))
        new[two] = np.minimum(new[two], np.where(link, new[one][:, None], most).min(axis=0))
        if (new == low).all():
            break
        low = new
    return n, low


def verify(placed: DataFrame, cosine: float) -> DataFrame:
    """(rid, n, u, v): the links of a row in a tile, and its way to the smallest id there."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(batches):
        held = None
        for rb in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), rb])
            tile = held["tile"].to_numpy()
            whole = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
            if whole:
                yield from run(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from run(held)

    def run(t: pa.Table):
        tile, side, ids = t["tile"].to_numpy(), t["side"].to_numpy(), t["vec_id"].to_numpy()
        vec = t["vec"].to_pylist()
        at = np.concatenate([np.flatnonzero(np.diff(tile, prepend=tile[0] - 1)), [len(tile)]]).tolist()
        n, low = np.zeros(len(tile), np.int64), ids.copy()
        for a, b in zip(at, at[1:]):
            if b - a > 1 and (side[a] == 2 or side[a] != side[b - 1]):
                x = np.frombuffer(b"".join(vec[a:b])).reshape(b - a, -1)
                n[a:b], low[a:b] = _tile(ids[a:b], x, side[a:b], cosine)
        use = n > 0
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[use], pa.int64()) for c in (t["rid"].to_numpy(), n, ids, low)], ["rid", "n", "u", "v"])

    ordered = placed.select("tile", "side", "rid", "vec_id", "vec").repartition(parts, "tile").sortWithinPartitions("tile", "side")
    return ordered.mapInArrow(kernel, "rid long, n long, u long, v long")


def near_duplicates(rows: DataFrame, cosine: float = 0.95, pivots: int = PIVOTS, near: int = NEAR, shared: int = SHARED, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """One row per distinct (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in doubles, is `cosine` or more (which must be positive).  Pairs that share
    fewer than `shared` of their `near` nearest pivots are not found: at the defaults that loses about 1.2 % of pairs
    at a cosine of 0.95 in 64 dimensions and less above; near closer to shared finds fewer, more pivots make shorter
    lists.  All that are found are verified, and none is left out for the size of a list, cell or component.

    Null, empty and zero vectors, those with null or non-finite components and rows without vec_id link with
    nothing (component_id is their own vec_id); vectors of unlike lengths never link.  Repeated rows are one vector;
    unlike vectors of one vec_id are vectors of their own that share its component.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    util.ship(spark)
    plain = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].alias("vec"))
    every = util.persist(plain.distinct())
    fine = usable(F.col("vec")) & F.col("vec_id").isNotNull()
    indexed = index(every.where(fine), pivots, near)
    cells = util.persist(indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("least")))
    own = cells.where("rows > 1").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    pairs = util.persist(meeting(indexed, shared).unionByName(own))
    crowds = cells.where(F.col("rows") > crowd)
    if crowds.isEmpty():
        judged = pairs.withColumn("verdict", F.lit(0))
    else:
        judged = util.persist(settled(pairs, balls(indexed, crowds), cosine))

    # whole pairs of cells: sums and links by cell
    all_linked = judged.where("verdict = 1").select("a", "b")
    both = all_linked.unionByName(all_linked.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = cells.select(F.col("cell").alias("b"), "rows", "least")
    sums = both.join(size, "b").groupBy(F.col("a").alias("cell")).agg(F.sum(F.col("rows") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("whole"), F.min("least").alias("to"))
    sums = util.persist(sums)
    names = cells.select(F.col("cell").alias("a"), F.col("least").alias("u"))
    links = both.where("a < b").join(names, "a").join(size, "b").select("u", F.col("least").alias("v"))
    links = links.unionByName(indexed.join(sums, "cell").select(F.col("vec_id").alias("u"), F.col("to").alias("v")))

    # the other pairs: tiles of a block by a block
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    left, right = cells.select(F.col("cell").alias("a"), blocks("rows").alias("na")), cells.select(F.col("cell").alias("b"), blocks("rows").alias("nb"))
    open_ = judged.where("verdict = 0").join(left, "a").join(right, "b")
    tiles = open_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = util.persist(tiles.where("a <> b or i <= j").withColumn("tile", F.monotonically_increasing_id()))
    same = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    asks = tiles.select("tile", F.when(same, 2).otherwise(0).alias("side"), F.col("a").alias("cell"), F.col("i").alias("blk"))
    asks = asks.unionByName(tiles.where(~same).select("tile", F.lit(1).alias("side"), F.col("b").alias("cell"), F.col("j").alias("blk")))
    wide = cells.where(F.col("rows") > block).select("cell", blocks("rows").alias("n"))
    cut = indexed.join(wide, "cell", "left").select("rid", "vec_id", "vec", "cell", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), "n")).cast("int").alias("blk"))
    found = util.persist(verify(cut.join(asks, ["cell", "blk"]), cosine))

    links = links.unionByName(found.select("u", "v")).where("u <> v")
    root = components.components(links)
    counted = found.groupBy("rid").agg(F.sum("n").alias("n"))
    mine = indexed.select("rid", "vec_id", "cell").join(counted, "rid", "left").join(sums, "cell", "left")
    mine = mine.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("whole", F.lit(0))).alias("n_links"))
    out = mine.unionByName(every.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(root, out["vec_id"] == root["node"], "left").select("vec_id", F.col("n_links").cast("long"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; DuckDB has no index for it.
SQL = """
with recursive v as (
  select distinct vec_id, embedding, [x::double for x in embedding] as e from embeddings
), u as (
  select * from v where vec_id is not null and len(e) > 0 and list_bool_and([x is not null and isfinite(x) for x in e]) and list_bool_or([x <> 0 for x in e])
), l as (
  select a.vec_id as x, b.vec_id as y, b.embedding as other, a.embedding as own from u a join u b on (a.vec_id <> b.vec_id or a.embedding <> b.embedding) and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
), r(x, y) as (
  select vec_id, vec_id from v union select r.x, l.y from r join l on l.x = r.y
), c as (select x, min(y) as component_id from r group by x)
select v.vec_id, (select count(*) from l where l.x = v.vec_id and l.own = v.embedding) as n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) as kept
from v left join c on c.x = v.vec_id
"""

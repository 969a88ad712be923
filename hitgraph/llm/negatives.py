"""Hard negatives for contrastive training, by branch and bound over ball trees.

Rows and anchors are dealt into blocks; a task holds one block of each, builds ball trees over its rows and searches
them for all its anchors together.  A ball of centre c and radius r bounds the inner product with q on both sides by
q.c - |q| r and q.c + |q| r: a node goes where it lies outside the window of scores or strictly beneath the kth
score so far.  The best of each block are then merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import util

#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 4096
#: Rows of a tree's leaf.
LEAF = 96
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max


class Tree:
    """A ball tree over rows of whole numbers; node 0 is the root, children follow their parent."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        order = np.arange(len(x))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[order[a:b]].astype(np.float64)
            centre = own.mean(axis=0)
            away = own - centre
            far = np.einsum("ij,ij->i", away, away)
            node = len(self.span)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(far.max())))
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > LEAF and far.max() > 0:
                split = np.argsort(away @ self._direction(away), kind="stable")
                order[a:b] = order[a:b][split]
                mid = (a + b) // 2
                todo += [(mid, b, node), (a, mid, node)]
        for node, (a, b) in enumerate(self.span):
            if not self.children[node]:  # columns of a leaf in order of id: ties then fall to the smaller one
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]

    @staticmethod
    def _direction(away: np.ndarray) -> np.ndarray:
        """A direction in which rows differ: two power steps from a fixed random one, so crowds fall apart along it."""
        v = np.random.default_rng(away.shape[1]).normal(size=away.shape[1])
        for _ in range(2):
            v = away.T @ (away @ v)
            v /= max(np.sqrt((v * v).sum()), 1e-300)
        return v


def trees(x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple[int | None, Tree]]:
    """A tree for each label with a leaf of rows at least, and one (label None) for all the others."""
    names, code, n = np.unique(labels, return_inverse=True, return_counts=True)
    out, rest = [], np.ones(len(x), bool)
    for k in np.flatnonzero(n >= LEAF).tolist():
        use = code == k
        rest &= ~use
        out.append((int(names[k]), Tree(x[use], ids[use], labels[use])))
    if rest.any():
        out.append((None, Tree(x[rest], ids[rest], labels[rest])))
    return out


class Best:
    """For each query and window of scores [low, high] the k best rows so far: higher scores, then smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), LOWEST, np.int64)
        self.id = np.full((*low.shape, k), HIGHEST, np.int64)

    def need(self, q: np.ndarray) -> np.ndarray:
        """The least score that still counts, by window."""
        return np.maximum(self.low[q], self.score[q, :, -1])

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of the rows `ids` (ascending) for the queries q."""
        need = self.need(q)
        hit = (allowed & (score >= need.min(axis=1)[:, None]) & (score <= self.high[q].max(axis=1)[:, None])).any(axis=1)
        if not hit.any():
            return
        q, need, allowed = q[hit], need[hit], allowed[hit]
        score = np.where(allowed, score[hit], LOWEST)
        # columns ascend in id, and the sort is stable: equal scores stay in order of id
        order = np.argsort(np.negative(np.where(score == LOWEST, LOWEST + 1, score)), axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        ids = ids[order]
        for w in range(self.low.shape[1]):
            first = (score > self.high[q, w][:, None]).sum(axis=1)
            at = first[:, None] + np.arange(self.k)
            inside = at < score.shape[1]
            at = np.minimum(at, score.shape[1] - 1)
            new, new_id = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)
            fine = inside & (new >= need[:, w][:, None]) & (new > LOWEST)
            use = fine.any(axis=1)
            if not use.any():
                continue
            new, new_id = np.where(fine, new, LOWEST)[use], np.where(fine, new_id, HIGHEST)[use]
            mine = q[use]
            s, i = np.concatenate([self.score[mine, w], new], axis=1), np.concatenate([self.id[mine, w], new_id], axis=1)
            top = np.lexsort((i, np.negative(np.where(s == LOWEST, LOWEST + 1, s))), axis=-1)[:, : self.k]
            self.score[mine, w], self.id[mine, w] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def search(forest: list[tuple[int | None, Tree]], q: np.ndarray, labels: np.ndarray, ids: np.ndarray, best: Best, same: bool) -> None:
    """Fill `best` with rows of the queries' own labels but other ids, or of other labels."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    lowest, top = best.low.astype(np.float64), best.high.astype(np.float64)
    for label, tree in forest:
        start = np.arange(len(q)) if label is None else np.flatnonzero((labels == label) == same)
        todo = [(0, start)]
        while todo:
            node, act = todo.pop()
            if not len(act):
                continue
            mid, reach = q[act].astype(np.float64) @ tree.centre[node], norm[act] * tree.radius[node]
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
            above, below = mid + reach + slack, mid - reach - slack
            need = np.maximum(lowest[act], best.score[act, :, -1])
            act = act[((above[:, None] >= need) & (below[:, None] <= top[act])).any(axis=1)]
            if tree.children[node]:
                # the child that promises more is searched first: its scores prune the other
                todo += [(c, act) for c in sorted(tree.children[node], key=lambda c: float((q[act].astype(np.float64) @ tree.centre[c]).sum()))]
            elif len(act):
                a, b = tree.span[node]
                score = q[act] @ tree.x[a:b].T
                allowed = (labels[act][:, None] == tree.labels[None, a:b]) == same
                if same:
                    allowed &= ids[act][:, None] != tree.ids[None, a:b]
                best.add(act, score.astype(np.int64), tree.ids[a:b], allowed)


def numbers(*columns: pa.ChunkedArray, scale: float) -> list[np.ndarray]:
    """floor(scale * component) of list columns of one length, in a type in which their inner products are exact."""
    out = []
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        out.append(np.floor(scale * c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(c), -1))
    width = max(1, out[0].shape[1])
    most = float(np.prod([max(1.0, float(np.abs(x).max(initial=0.0))) for x in out])) * width
    if most >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return out if most < 2.0**53 else [x.astype(np.int64) for x in out]


def _grid(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block (i, j) of anchors and rows in which they meet; a row meets every anchor once."""
    n_rows, n_anchors = rows.count(), anchors.count()
    ni, nj = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    own = F.pmod(F.xxhash64("rid"), F.lit(nj)).cast("int")
    left = rows.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
    own = F.pmod(F.xxhash64("q_rid"), F.lit(ni)).cast("int")
    right = anchors.withColumn("q_i", own).withColumn("q_j", F.explode(F.sequence(F.lit(0), F.lit(nj - 1))))
    return left, right


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label; anchors: a condition on them.  A score is the inner product of the vectors with
    each component x as floor(scale * x), exact in whole numbers; higher ones come first, ties by smaller vec_id.  The
    positives of an anchor are its first `positives` rows of its label and another vec_id; the negatives of both
    the first `negatives` of another label with low * positive <= 100 * score <= high * positive.

    Rows without vec_id, label or vector or with null or non-finite components take no part; vectors of unlike lengths do not
    meet; empty vectors have the score 0.  Repeated rows count once; unlike rows of one vec_id are rows of their own.
    An anchor without positives, or a positive without negatives, has no rows.  Raises if scores leave 64 bits.
    """
    spark = rows.sparkSession
    util.ship(spark)
    vec = F.col("vec")
    plain = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].alias("vec"), rows["label"].cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fine = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    every = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & fine).distinct()
    every = util.persist(every.withColumn("rid", F.monotonically_increasing_id()).withColumn("len", F.size("vec")))
    queries = every.where("anchor").select(*[F.col(c).alias(f"q_{c}") for c in ("rid", "vec_id", "vec", "label", "len")])

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("rid", "positive_id", "score")})
        x, q = numbers(left["vec"], right["q_vec"], scale=scale)
        one = (len(q), 1)
        best = Best(np.full(one, LOWEST + 1), np.full(one, HIGHEST), positives)
        search(trees(x, left["vec_id"].to_numpy(), left["label"].to_numpy()), q, right["q_label"].to_numpy(), right["q_vec_id"].to_numpy(), best, True)
        at, _, k = np.nonzero(best.score > LOWEST)
        return pa.table({"rid": right["q_rid"].to_numpy()[at], "positive_id": best.id[at, 0, k], "score": best.score[at, 0, k]})

    left, right = _grid(every.select("rid", "vec_id", "vec", "label", "len"), queries)
    met = left.groupBy("len", "i", "j").cogroup(right.groupBy("q_len", "q_i", "q_j"))
    place = Window.partitionBy("rid").orderBy(F.desc("score"), "positive_id")  # `positives` rows of each block of rows at most
    best = met.applyInArrow(first, "rid long, positive_id long, score long").withColumn("slot", F.row_number().over(place) - 1).where(F.col("slot") < positives)
    best = util.persist(best)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "negative_id": pa.array([], pa.int64()), "negative_score": pa.array([], pa.int64())})
        x, q = numbers(left["vec"], right["q_vec"], scale=scale)
        scores = right["scores"].to_pylist()
        lows, highs = np.full((len(q), positives), HIGHEST), np.full((len(q), positives), LOWEST + 1)
        for a, mine in enumerate(scores):
            for w, s in enumerate(mine):  # Python's whole numbers do not overflow
                lows[a, w], highs[a, w] = -((-low * s) // 100), (high * s) // 100
        best = Best(lows, highs, negatives)
        search(trees(x, left["vec_id"].to_numpy(), left["label"].to_numpy()), q, right["q_label"].to_numpy(), right["q_vec_id"].to_numpy(), best, False)
        at, slot, k = np.nonzero(best.score > LOWEST)
        return pa.table({"rid": right["q_rid"].to_numpy()[at], "slot": pa.array(slot, pa.int32()), "negative_id": best.id[at, slot, k], "negative_score": best.score[at, slot, k]})

    windows = best.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda s: s["score"]).alias("scores"))  # `positives` numbers
    left, right = _grid(every.select("rid", "vec_id", "vec", "label", "len"), queries.join(windows, F.col("q_rid") == F.col("rid")).drop("rid"))
    met = left.groupBy("len", "i", "j").cogroup(right.groupBy("q_len", "q_i", "q_j"))
    place = Window.partitionBy("rid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    mined = met.applyInArrow(second, "rid long, slot int, negative_id long, negative_score long").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    out = mined.join(best.withColumnRenamed("score", "positive_score"), ["rid", "slot"]).join(queries.select(F.col("q_rid").alias("rid"), F.col("q_vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id))::int as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""

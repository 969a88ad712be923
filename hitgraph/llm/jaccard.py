"""N-gram Jaccard join by grouped prefixes, and the components that its links make.

A document's set is its distinct shingles of SIZE words.  Equal sets are one class.  Shingles have one global order:
those not known as frequent by hash, then the frequent ones by rising count.  With threshold t the first
|x| - ceil(t|x|) + 1 shingles of two linked sets share one (for the smaller set a shorter, indexed prefix is
enough).  Classes with equal prefix and size are one group; groups that meet at a shingle and pass the size and
position filters are pairs; pairs expand to their classes and are verified on whole sets.

Only components are asked for, so a pair whose classes are already connected needs no verification.  Round one takes
the neighbours in each shingle's list (sorted by size), round two all pairs that are still in different
components, but of crowded lists two partners of each class, round three the rest of those lists.
No link between different components is lost, and copies never expand into all pairs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .components import components

SIZE = 3
PERCENT = 90
#: Frequent shingles in the order's table at most: it decides only the order, so any table gives the same links.
FREQUENT = 100_000
_FLUSH = 500_000
#: Bytes of the bitmap that list entries carry.
SMALL = 64
#: Columns of the first shingles that an entry's group shares with others: a pair is made at the first one that both have.
_EARLY = ("e0", "e1", "e2")
_BROADCAST_IDS = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_I64 = np.int64


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle names (63 bits) of each text."""
    raw, off = util.buffers(column)
    low, off = util.separated(raw, off, lower=True)
    raw = np.frombuffer(low, np.uint8)
    starts, ends = util.starts_ends(~_SPACE[raw], off)
    h = util.word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, off)
    n = len(h)
    every = util.grams(h, np.arange(max(0, n - size + 1)), size) & np.uint64((1 << 63) - 1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(util.grams(h, np.array([a]), b - a) & np.uint64((1 << 63) - 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A name of the whole set."""
    return int(util.mix(np.array([np.add.reduce(util.mix(s + np.uint64(5)))], np.uint64) + np.uint64(len(s))).view(_I64)[0])


def group_of(prefix: np.ndarray, n: int) -> int:
    """A name of the prefix and the set's size."""
    return int(util.mix(np.array([np.add.reduce(util.mix(prefix + np.uint64(11)))], np.uint64) * np.uint64(31) + np.uint64(n)).view(_I64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit, as many bits as shingles or more (512 to 65536).

    Where two differ is at most how many shingles the sets do not share, and nearly that if those are few.
    """
    bits = min(65_536, max(512, 1 << (len(s) - 1).bit_length())) if len(s) else 512
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(_I64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(b: bytes, size: int = 64) -> np.ndarray:
    """The bitmap with fewer bits, as bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size), axis=0)


def differ(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return int(_ONES[folded(x, size) ^ folded(y, size)].sum())


_ONES = np.array([bin(i).count("1") for i in range(256)], _I64)


def need(n, m, percent):
    """Shared shingles that sets of n and m need to link."""
    return -(-percent * (n + m) // (100 + percent))


def _first_scan(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, class, set size, bitmap; kind 1: shingle, how often, for those repeated within a task's share."""

    def kernel(batches):
        held: list[np.ndarray] = []
        total = 0

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            some = n >= 4
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(some.sum(), np.int32)), "a": pa.array(v[some].view(_I64)), "b": pa.array(n[some].astype(_I64)), "n": pa.array(np.zeros(some.sum(), np.int32)), "bits": pa.nulls(some.sum(), pa.binary()), "small": pa.nulls(some.sum(), pa.binary())})

        for rb in util.slices(batches, "text"):
            sets = shingle_sets(rb.column("text"), size)
            bits = [bitmap(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(np.zeros(len(sets), np.int32)), "a": rb.column("doc_id"), "small": pa.array([folded(b, SMALL).tobytes() for b in bits], pa.binary()), "b": pa.array([class_of(s) if len(s) else 0 for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "bits": pa.array(bits, pa.binary())}
            )
            seen = {class_of(s): s for s in sets if len(s)}
            held.extend(seen.values())
            total += sum(map(len, seen.values()))
            if total >= _FLUSH:
                yield flush()
                total = 0
        if held:
            yield flush()
        util.release()

    names = ["kind", "a", "b", "n", "bits", "small"]
    ordered = lambda batches: (rb.select(names) for rb in kernel(batches))
    return docs.select("doc_id", "text").mapInArrow(ordered, "kind int, a long, b long, n int, bits binary, small binary")


class Order:
    """The global order of shingles, as one number each."""

    def __init__(self, frequent: np.ndarray) -> None:
        """frequent: by rising count."""
        order = np.argsort(frequent)
        self.value, self.rank = frequent[order], order.astype(np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.value >> np.uint64(43)).astype(_I64)] = True

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Unsigned keys, ascending; a frequent shingle's has the top bit."""
        out = s.copy()
        some = np.flatnonzero(self.maybe[(s >> np.uint64(43)).astype(_I64)])
        if len(some) and len(self.value):
            at = np.minimum(np.searchsorted(self.value, s[some]), len(self.value) - 1)
            hit = self.value[at] == s[some]
            out[some[hit]] = np.uint64(1 << 63) | self.rank[at[hit]]
        return np.sort(out)


def _second_scan(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Prefix entries of each group once a task (pos >= 0, cls 0), and the classes of each group (pos -1)."""

    def kernel(batches):
        order = Order(frequent)
        seen: set[tuple[int, int]] = set()
        groups: set[int] = set()
        for rb in util.slices(batches, "text"):
            cols: dict[str, list] = {k: [] for k in ("gid", "cls", "n", "key", "pos", "indexed")}
            for s in shingle_sets(rb.column("text"), size):
                n = len(s)
                if not n:
                    continue
                keys = order.keys(s)
                prefix = keys[: n - (-(-percent * n // 100)) + 1]
                gid = group_of(prefix, n)
                c = class_of(s)
                if (gid, c) in seen:
                    continue
                if len(seen) > _FLUSH:
                    seen.clear()
                    groups.clear()
                seen.add((gid, c))
                p = prefix[:0] if gid in groups else prefix
                groups.add(gid)
                k = len(p) + 1
                pos = np.arange(-1, len(p), dtype=np.int32)
                cols["gid"].append(np.full(k, gid))
                cols["cls"].append(np.where(pos < 0, _I64(c), _I64(0)))
                cols["n"].append(np.full(k, n, np.int32))
                cols["key"].append(np.concatenate([[gid], p.view(_I64)]))
                cols["pos"].append(pos)
                cols["indexed"].append((pos >= 0) & (pos < n - need(n, n, percent) + 1))
            if cols["gid"]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in cols.items()})
        util.release()

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(kernel, "gid long, cls long, n int, key long, pos int, indexed boolean")


def _columns(batches, *names) -> list[np.ndarray] | None:
    held = [[rb.column(n).to_numpy(zero_copy_only=False) for n in names] for rb in batches if rb.num_rows]
    return [np.concatenate(x) for x in zip(*held)] if held else None


def _meeting(entries: DataFrame) -> DataFrame:
    """Sorted entries whose shingle another group has too (or may have, in the next part), each group once; group rows."""

    def kernel(batches):
        got = _columns(batches, "gid", "cls", "n", "key", "pos", "indexed")
        if got is None:
            return
        gid, cls, n, key, pos, indexed = got
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (gid[1:] != gid[:-1]) | (pos[1:] != pos[:-1]) | (pos[1:] < 0)
        gid, cls, n, key, pos, indexed = (x[keep] for x in (gid, cls, n, key, pos, indexed))
        meets = np.zeros(len(key), bool)
        meets[0] = meets[-1] = True
        same = key[1:] == key[:-1]
        meets[1:] |= same
        meets[:-1] |= same
        meets |= pos < 0
        names = ("gid", "cls", "n", "key", "pos", "indexed")
        yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(x[meets]) for x in (gid, cls, n.astype(np.int32), key, pos.astype(np.int32), indexed)))))

    return entries.mapInArrow(kernel, "gid long, cls long, n int, key long, pos int, indexed boolean")


def _fits(n, i, m, j, percent):
    """Size and position filters: x of n meets y of m <= n at places i, j, the first shingle that they share."""
    return (100 * m >= percent * n) & (np.minimum(n - i, m - j) >= need(n, m, percent))


def _neighbours(entries: DataFrame, percent: int) -> DataFrame:
    """Round one: groups (a, b), each entry with the last indexed one before it in its shingle's list."""

    def kernel(batches):
        got = _columns(batches, "gid", "n", "key", "pos", "indexed")
        if got is None:
            return
        gid, n, key, pos, indexed = got
        last = np.maximum.accumulate(np.where(indexed, np.arange(len(key)), -1))
        y = np.concatenate([[-1], last[:-1]])
        x = np.flatnonzero(y >= 0)
        y = y[x]
        ok = (key[x] == key[y]) & (gid[x] != gid[y]) & (n[y] <= n[x])
        x, y = x[ok], y[ok]
        ok = _fits(n[x].astype(_I64), pos[x], n[y].astype(_I64), pos[y], percent)
        yield pa.RecordBatch.from_pydict({"a": pa.array(gid[x[ok]]), "b": pa.array(gid[y[ok]])})

    pairs = entries.mapInArrow(kernel, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bitmaps(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SMALL) bytes of a column of bitmaps, zero where it is null, and which rows have one."""
    column = column.combine_chunks()
    lone = column.is_valid().to_numpy(zero_copy_only=False)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    given = (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)).reshape(-1, SMALL)
    if lone.all():
        return given, lone
    bits = np.zeros((len(column), SMALL), np.uint8)
    bits[lone] = given
    return bits, lone


def _earliest(entries: DataFrame) -> DataFrame:
    """gid and its first entries (place, shingle) that meet another group's; a group's entries are its prefix at most."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "key"))), 1, len(_EARLY))
    return util.persist(entries.groupBy("gid").agg(first.alias("early")))


def _pairs_apart(entries: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) in the lists of shingles whose components differ and that pass the filters.

    A list with over `most` such pairs an entry gives the last two of each entry only, and its shingle as `over`.  A
    pair with one of both sides' first shingles (_EARLY) in common is left to that one's list.
    """

    def kernel(batches):
        held: list[pa.RecordBatch] = [rb for rb in batches if rb.num_rows]
        if not held:
            return
        key, comp = _columns(held, "key", "comp")
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        stays = np.repeat(several, np.diff(np.append(starts, len(key))))
        if not stays.any():
            return
        cut = np.cumsum([0, *(rb.num_rows for rb in held)])
        held = [rb.filter(pa.array(stays[i:j])) for rb, i, j in zip(held, cut[:-1], cut[1:])]
        gid, n, key, pos, indexed, comp = _columns(held, "gid", "n", "key", "pos", "indexed", "comp")
        early = _columns(held, *_EARLY)
        bits, lone = _bitmaps(pa.chunked_array([rb.column("bits") for rb in held], pa.binary()))
        held.clear()
        n = n.astype(_I64)
        size = len(key)
        begin = np.searchsorted(key, key, side="left")
        # key then size ascend, so the partners of a row are a stretch before it
        list_no = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        scale = int(n.max()) + 1
        a = np.maximum(np.searchsorted(list_no * scale + n, list_no * scale + -(-percent * n // 100), side="left"), begin)
        many = np.arange(size) - a
        total = np.cumsum(many)
        at = 0
        while at < size:
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, side="right")))
            m = many[at:stop]
            x = np.repeat(np.arange(at, stop), m)
            y = np.repeat(a[at:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            ok = indexed[y] & (comp[x] != comp[y])
            x, y = x[ok], y[ok]
            ok = _fits(n[x], pos[x], n[y], pos[y], percent)
            x, y = x[ok], y[ok]
            for e in early:  # a pair with an earlier shingle in common stands in that one's list
                own = e[x]
                later = own != key[x]
                for f in early:
                    ok = ~(later & (own == f[y]))
                    x, y, own, later = x[ok], y[ok], own[ok], later[ok]
            ok = np.zeros(len(x), bool)
            for k in range(0, len(x), 20_000):
                z = slice(k, k + 20_000)
                ok[z] = (_ONES[bits[x[z]] ^ bits[y[z]]].sum(1) <= n[x[z]] + n[y[z]] - 2 * need(n[x[z]], n[y[z]], percent)) | ~(lone[x[z]] & lone[y[z]])
            x, y = x[ok], y[ok]
            full = np.zeros(len(x), bool)
            if most is not None and len(x):
                full = (np.bincount(list_no[x]) > most * np.bincount(list_no, minlength=1)[: int(list_no[x].max()) + 1])[list_no[x]]
                ok = ~full | (np.searchsorted(x, x, side="right") - np.arange(len(x)) <= 2)
                x, y, full = x[ok], y[ok], full[ok]
            over, x, y = key[x], gid[x], gid[y]
            p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), np.where(full, over, 0), full], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(p[:, 0])), "b": pa.array(np.ascontiguousarray(p[:, 1])), "over": pa.array(np.ascontiguousarray(p[:, 2]), mask=p[:, 3] == 0)})
            at = stop
        util.release()

    return entries.mapInArrow(kernel, "a long, b long, over long")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, members (whole sets) of the wanted classes (rep, cls), from their first documents' texts."""
    if wanted.count() <= _BROADCAST_IDS:  # 16 bytes each
        wanted = F.broadcast(wanted)

    def kernel(batches):
        for rb in util.slices(batches, "text"):
            sets = shingle_sets(rb.column("text"), size)
            names = np.array([class_of(s) if len(s) else 0 for s in sets], _I64)
            some = np.flatnonzero(names == rb.column("cls").to_numpy())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(names[some]), "members": pa.array([sets[i].tobytes() for i in some], pa.binary())})

    return rows.join(wanted, rows["doc_id"] == wanted["rep"]).select("text", "cls").mapInArrow(kernel, "cls long, members binary")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between the first documents of classes a, b whose sets reach the threshold.

    The bitmaps sieve without error of the first kind; whole sets are read for the pairs that they leave only.
    """
    one = lambda p: classes.select(F.col("cls").alias(p), F.col("rep").alias(f"rep_{p}"), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))

    def sieve(batches):
        for rb in batches:
            n, m = rb.column("n_a").to_numpy().astype(_I64), rb.column("n_b").to_numpy().astype(_I64)
            apart = np.array([differ(x, y) for x, y in zip(rb.column("bits_a").to_pylist(), rb.column("bits_b").to_pylist())], _I64)
            yield rb.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(apart <= n + m - 2 * need(n, m, percent)))

    close = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "bits_a", "bits_b")
    close = util.persist(close.mapInArrow(sieve, "a long, b long, rep_a long, rep_b long"))
    wanted = close.select(F.col("rep_a").alias("rep"), F.col("a").alias("cls")).unionAll(close.select("rep_b", "b")).distinct()
    sets = util.persist(_sets(rows, util.persist(wanted), size))
    whole = lambda p: sets.select(F.col("cls").alias(p), F.col("members").alias(f"set_{p}"))

    def exact(batches):
        for rb in util.slices(batches, "set_a"):
            ok = []
            for x, y in zip(rb.column("set_a"), rb.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            u, v = rb.column("rep_a").to_numpy()[ok], rb.column("rep_b").to_numpy()[ok]
            yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    links = close.join(whole("a"), "a").join(whole("b"), "b").select("rep_a", "rep_b", "set_a", "set_b").mapInArrow(exact, "u long, v long")
    return util.persist(links)


def _still_apart(entries: DataFrame, early: DataFrame, groups: DataFrame, labels: DataFrame, percent: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(pairs, keys of lists that gave not all of them): pairs of classes in different components that meet at a shingle, or within a group of several classes."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = groups.join(labels, groups["rep"] == labels["node"], "left").select("gid", "cls", F.coalesce("component", "rep").alias("comp"), "small")
    at = util.persist(at)
    mixed = at.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.min("small").alias("bits"))
    # a group over several components differs from every other: its own name, never a doc_id in use with it;
    # a group of several classes is not sieved in the lists
    mixed = mixed.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.abs(F.col("gid")) - 1).alias("comp"), F.when(F.col("k") == 1, F.col("bits")).alias("bits"))
    before = [F.coalesce(F.when(F.get("early", i)["pos"] < F.col("pos"), F.get("early", i)["key"]), F.col("key")).alias(e) for i, e in enumerate(_EARLY)]  # its own shingle: none
    named = entries.select("gid", "n", "key", "pos", "indexed").join(early, "gid").select("gid", "n", "key", "pos", "indexed", *before)
    open_ = named.join(mixed, "gid").repartition(parts, "key").sortWithinPartitions("key", "n", "gid")
    met = util.persist(_pairs_apart(open_, percent, most))
    far = met.select("a", "b").distinct()
    side = lambda p: at.select(F.col("gid").alias(p), F.col("cls").alias(f"c_{p}"), F.col("comp").alias(f"o_{p}"))
    wide = far.join(side("a"), "a").join(side("b"), "b").where("o_a <> o_b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    l, r = at.alias("l"), at.alias("r")
    within = l.join(r, (F.col("l.gid") == F.col("r.gid")) & (F.col("l.cls") < F.col("r.cls")) & (F.col("l.comp") != F.col("r.comp"))).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
    return util.persist(wide.unionByName(within).distinct()), met.where("over is not null").select(F.col("over").alias("key")).distinct()


def similar_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, crowd: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with, over others too).

    Texts without words have no set and link with nothing; fewer words than a shingle make one shingle; repeated rows
    are linked copies; a null doc_id keeps its row, links with nothing and has a null component.  A doc_id on several
    different texts is one document, whose texts' links all count.
    crowd: pairs an entry beyond which a list waits for the last round; it decides the cost, not the result.
    """
    spark = docs.sparkSession
    util.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))

    first = util.persist(_first_scan(rows, size))
    members = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), "n", "bits", "small")
    top = first.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).orderBy(F.desc("c"), "a").limit(FREQUENT).toPandas()
    frequent = top.sort_values(["c", "a"])["a"].to_numpy(_I64).view(np.uint64)
    classes = util.persist(members.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("small").alias("small")))

    entries = _second_scan(rows, size, percent, frequent)
    entries = util.persist(_meeting(entries.repartitionByRange(parts, "key", "n", "gid").sortWithinPartitions("key", "n", "gid", "pos")))
    groups = entries.where("pos < 0").select("gid", "cls").distinct().join(classes.select("cls", "rep", "small"), "cls")
    groups = util.persist(groups)
    entries = entries.where("pos >= 0")
    least = groups.groupBy("gid").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("k"))

    inside = groups.join(least.where("k > 1"), "gid").where("cls <> least").select(F.least("cls", "least").alias("a"), F.greatest("cls", "least").alias("b"))
    first_of = lambda p: least.select(F.col("gid").alias(p), F.col("least").alias(f"c_{p}"))
    near = _neighbours(entries, percent).join(first_of("a"), "a").join(first_of("b"), "b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    links = _verified(near.unionByName(inside).distinct(), classes, rows, size, percent)
    labels = components(links)

    early = _earliest(entries)
    for most in (crowd, None):
        pairs, over = _still_apart(entries, early, groups, labels, percent, most)
        more = _verified(pairs, classes, rows, size, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        over = util.persist(over)
        if over.isEmpty():
            break
        entries = entries.join(over, "key", "left_semi")

    named = members.select("doc_id", "cls", "n").join(classes.select("cls", "rep"), "cls", "left")
    out = named.join(labels, named["rep"] == labels["node"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are first of their component (smallest doc_id), all columns; of repeated rows one stays.

    Documents without words stay; so do those without a doc_id, and different texts of one doc_id.
    """
    first = similar_components(docs, size, percent).where("component_id = doc_id").select(F.col("doc_id").alias("_stays")).distinct()
    first = util.persist(first)
    ids, name = docs["doc_id"].cast("long"), f"h{uuid.uuid4().hex}"  # no column of docs is called so
    stay = docs.withColumn(name, F.xxhash64(docs["text"])).join(first, ids == first["_stays"], "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return stay.unionByName(docs.where(docs["doc_id"].isNull()))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for DuckDB, for tables so small that all pairs which share a shingle can be counted.
SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
 e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id"""


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Repeated byte strings over the whole corpus, by bucket-pointer refinement of sampled suffixes.

Every window of LENGTH bytes is represented by one suffix inside it: the leftmost q-gram of least hash.  Equal
windows choose the same suffix at the same offset, so comparing sampled suffixes loses no repeat, and about one
suffix in 75 bytes is enough.  Refinement, as in a bucket-pointer suffix sort, orders suffixes by bucket identifiers:

0. initial buckets: the q-gram at the suffix;
1. a bucket is refined by the identifier of the whole stretch that the suffix stands for (all windows that chose
   it): suffixes that stay together are repeats in full, a bucket left with one suffix has none;
2. buckets that split are refined by blocks of windows at like offsets from their q-gram: the bytes that all windows of
   a block share name its bucket (alone there, no window of it repeats), all its bytes refine it;
3. what is left is refined at each single window.  A window's bucket identifier is made of identifiers at later
   offsets, recursively: b(x, 2d) = name(b(x, d), b(x + d, d)).

Identifiers are names that any executor computes alike, so buckets need no global numbering: sorting on them is a
shuffle and a sort by partition.  Two strings count as equal if two names of 64 bits agree, that of a bucket and that
of the string.  Before each shuffle a task sends one entry for each pair of names it holds and answers for its own
copies itself; of a bucket that holds three strings or more in a task it sends but two, as marks that others are there,
and deals the rest by both names.  So no bucket is larger than twice the number of tasks' batches, however many copies
there are and however common a q-gram is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import util

LENGTH = 200
GRAM = 50
#: Windows of a block, at most.
BLOCK = 16
_CHUNK = 1 << 20
#: Entries that a task holds to settle its own copies before it sends them on.
HELD = 1_000_000
_I64 = np.int64
_U64 = np.uint64
#: Bits of a place: first window, then offset of the q-gram from it, windows less one, flags.
_REACH = 12
_LEAD, _HOT, _MARK, _KNOWN, _MANY = 1, 2, 4, 8, 16


def place(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return (((lo.astype(_I64) << _REACH | (at - lo)) << _REACH | (hi - lo)) << 5) | flags


def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place of the q-gram, flags)."""
    low = (1 << _REACH) - 1
    lo = x >> (2 * _REACH + 5)
    return lo, lo + ((x >> 5) & low), lo + ((x >> (_REACH + 5)) & low), x & 31


def suffixes(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The sampled suffixes: text, first and last window start (in the text) that chose it, its place, q-gram and stretch names."""
    n = len(raw)
    none = {k: np.zeros(0, _I64) for k in ("doc", "lo", "hi", "at", "key", "sub")}
    if n < length:
        return none
    roll = util.Rolling(util._BYTE[raw])
    at = np.arange(n - gram + 1)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    names = roll.of(at, at + gram)
    key = (names & ~low) | at.astype(np.uint64)
    w = length - gram + 1
    least, size = key, 1
    while size * 2 <= w:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    inside = np.zeros(len(least) + 1, _I64)
    first, last = off[:-1], off[1:] - length
    ok = last >= first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, last[ok] + 1, -1)
    x = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(x):
        return none
    chosen = (least[x] & low).astype(_I64)
    new = np.ones(len(x), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (x[1:] != x[:-1] + 1)
    begin = np.flatnonzero(new)
    lo, hi = x[begin], x[np.concatenate([begin[1:], [len(x)]]) - 1]
    doc = np.searchsorted(off, lo, side="right") - 1
    at = chosen[begin]
    return {"doc": doc, "lo": lo - off[doc], "hi": hi - off[doc], "at": at - off[doc], "key": names[at].view(_I64), "sub": roll.of(lo, hi + length).view(_I64)}


def blocks(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Stretches cut into blocks: (the stretch of each, first and last window, names of what its windows share and of all)."""
    size = max(1, min(BLOCK, length // 4))
    first, last = (at - hi) // size, (at - lo) // size
    many = last - first + 1
    which = np.repeat(np.arange(len(lo)), many)
    b = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    core = at[which] - b * size  # where the block's last window would begin
    x, y = np.maximum(lo[which], core - size + 1), np.minimum(hi[which], core)
    base = off[doc[which]]
    roll = util.Rolling(util._BYTE[raw])
    with np.errstate(over="ignore"):
        key = util.mix(roll.of(base + core, base + core + length - size + 1) + b.astype(_U64))
        sub = util.mix(roll.of(base + x, base + y + length) + (core - x).astype(_U64))
    return which, {"lo": x, "hi": y, "at": at[which], "key": key.view(_I64), "sub": sub.view(_I64)}


def window_names(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of windows, from those of shorter strings at later offsets."""
    b, depth = util._BYTE[raw], 1
    with np.errstate(over="ignore"):
        while depth * 2 <= length:
            b = util.mix(b[: len(b) - depth] * np.uint64(0x9FB21C651E98DF25) + b[depth:] + np.uint64(depth))
            depth *= 2
        a, z = b[starts], b[starts + (length - depth)]
        return util.mix(a * np.uint64(0xD6E8FEB86659FD93) + z + np.uint64(length)).view(_I64)


def settle(row: np.ndarray, e: dict[str, np.ndarray], known: np.ndarray, drop_known: bool = False) -> list[np.ndarray]:
    """What a task sends on of its entries: columns row, place, key, sub.

    Of entries alike (key and sub) one leads, an open one if there is any; the others are answered for and travel alone,
    or stay if known and drop_known.
    """
    order = np.lexsort((known, e["sub"], e["key"]))
    row, known = row[order], known[order]
    lo, hi, at, key, sub = (e[k][order] for k in ("lo", "hi", "at", "key", "sub"))
    bucket = np.ones(len(key), bool)
    bucket[1:] = key[1:] != key[:-1]
    lead = bucket.copy()
    lead[1:] |= sub[1:] != sub[:-1]
    many = ~lead
    many[:-1] |= ~lead[1:]
    # buckets of three strings and more
    begin = np.flatnonzero(bucket)
    strings = np.add.reduceat(lead, begin, dtype=_I64) if len(begin) else begin
    hot = np.repeat(strings > 2, np.diff(np.concatenate([begin, [len(key)]])))
    flags = lead * _LEAD | hot * _HOT | known * _KNOWN | many * _MANY
    spot = place(lo, hi, at, flags)
    leads = np.flatnonzero(lead)
    edge = np.ones(len(leads) + 1, bool)
    edge[1:-1] = bucket[leads[1:]]
    marks = leads[(edge[:-1] | edge[1:]) & hot[leads]]
    with np.errstate(over="ignore"):
        own = util.mix(row.view(_U64) ^ util.mix(spot.view(_U64))).view(_I64)
        both = util.mix(key.view(_U64) ^ util.mix(sub.view(_U64))).view(_I64)
    to = np.where(lead, np.where(hot, both, key), own)
    use = lead | ~known if drop_known else np.ones(len(key), bool)
    return [np.concatenate([c[use], m[marks]]) for c, m in ((row, row), (spot, spot | _MARK), (to, key), (sub, sub))]


_ENTRY = "row long, place long, key long, sub long"


class _Sender:
    """Holds entries of a task until they are settled together."""

    def __init__(self, drop_known: bool) -> None:
        self.drop_known, self.held, self.size = drop_known, [], 0

    def add(self, row: np.ndarray, e: dict[str, np.ndarray], known: np.ndarray):
        self.held.append((row, e, known))
        self.size += len(row)
        if self.size >= HELD:
            yield from self.send()

    def send(self):
        if self.size:
            e = {k: np.concatenate([h[1][k] for h in self.held]) for k in self.held[0][1]}
            cols = settle(np.concatenate([h[0] for h in self.held]), e, np.concatenate([h[2] for h in self.held]), self.drop_known)
            self.held.clear()
            self.size = 0
            for a in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000], pa.int64()) for c in cols], ["row", "place", "key", "sub"])


def _sample(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def kernel(batches):
        out = _Sender(False)
        for rb in util.slices(batches, "text", _CHUNK):
            raw, off = util.buffers(rb.column("text"))
            e = suffixes(raw, off, length, gram)
            row = rb.column("row").to_numpy()[e.pop("doc")]
            yield from out.add(row, e, np.zeros(len(row), bool))
        yield from out.send()

    return docs.select("row", "text").mapInArrow(kernel, _ENTRY)


def _finer(texts: DataFrame, length: int, windows: bool) -> DataFrame:
    """Entries of the next level: blocks of the runs, or their single windows (known by what their block shares, too)."""

    def kernel(batches):
        out = _Sender(True)
        for rb in util.slices(batches, "text", _CHUNK):
            raw, off = util.buffers(rb.column("text"))
            runs = rb.column("runs")
            doc = np.repeat(np.arange(rb.num_rows), np.diff(runs.offsets.to_numpy()))
            lo, hi, at, flags = placed(runs.flatten().to_numpy(zero_copy_only=False))
            which, e = blocks(raw, off, doc, lo, hi, at, length)
            if windows:
                many = e["hi"] - e["lo"] + 1
                x = np.repeat(e["lo"] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                which = np.repeat(which, many)
                name = window_names(raw, x + off[doc[which]], length)
                e = {"lo": x, "hi": x, "at": x, "key": name, "sub": np.repeat(e["key"], many)}
            yield from out.add(rb.column("row").to_numpy()[doc[which]], e, (flags[which] & _KNOWN) > 0)
        yield from out.send()

    return texts.select("doc_id", "row", "text", "runs").mapInArrow(kernel, _ENTRY)


def _flag(bit: int):
    return F.col("place").bitwiseAND(F.lit(bit)) != 0


def _answered(entries: DataFrame) -> DataFrame:
    """Entries with two answers: found (repeated in full) and refine (one of each string in a bucket of several)."""
    bucket, string = Window.partitionBy("key"), Window.partitionBy("key", "sub")
    # the finest order first: it serves all three windows
    e = entries.repartition("key").withColumns({"mark": _flag(_MARK), "known": _flag(_KNOWN)})
    e = e.withColumn("no", F.row_number().over(string.orderBy("mark", "known", "row", "place"))).withColumn("alike", F.count(F.lit(1)).over(string))
    e = e.withColumn("others", _flag(_HOT) | (F.min("sub").over(bucket) != F.max("sub").over(bucket)))
    e = e.withColumn("open", _flag(_HOT) | F.max(~_flag(_KNOWN)).over(bucket))
    return e.where(~_flag(_MARK)).select(
        "row", "place", ((F.col("alike") > 1) | _flag(_MANY)).alias("found"), (_flag(_LEAD) & F.col("others") & F.col("open") & (F.col("no") == 1)).alias("refine")
    )


def _spans(answered: DataFrame) -> DataFrame:
    """(row, first and last window) of what is found repeated and was open."""
    lo = F.shiftright("place", 2 * _REACH + 5)
    reach = F.shiftright("place", 5).bitwiseAND(F.lit((1 << _REACH) - 1))
    return answered.where(F.col("found") & ~_flag(_KNOWN)).select("row", lo.cast("int").alias("lo"), (lo + reach).cast("int").alias("hi"))


def _runs(answered: DataFrame) -> DataFrame:
    """(row, places to refine); what is found repeated counts as known from now on."""
    known = F.when(F.col("found"), F.col("place").bitwiseOR(F.lit(_KNOWN))).otherwise(F.col("place"))
    return answered.where("refine").groupBy(F.col("row").alias("run_row")).agg(F.collect_list(known).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept_sha256 after all repeated strings are removed.

    Strings of `length` bytes that start anywhere else too, same document included, are removed wherever they stand;
    overlaps count; strings never cross documents and are judged on the input.  Null texts are empty; texts shorter
    than a string stay whole; repeated rows are documents of their own, so their long texts go altogether.
    """
    spark = docs.sparkSession
    util.ship(spark)
    if length - gram >= 1 << _REACH or not 0 < gram <= length:
        raise ValueError("a string holds its q-gram, and fewer than 4096 more")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # of unlike documents no two have one row, but for 2 ** -24 of those that share a doc_id (ids beyond 2 ** 39: but for 2 ** -63)
    plain = F.shiftleft("doc_id", 24).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 24) - 1)))
    rows = rows.withColumn("row", F.coalesce(F.when(F.col("doc_id").between(0, (1 << 39) - 1), plain), F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63)))))

    first = util.persist(_answered(_sample(rows, length, gram)).where("found or refine"))
    # whole texts are shuffled once: this exchange serves the three joins below
    texts = rows.repartition("row")
    at_row = lambda d: texts.join(d, texts["row"] == d["run_row"]).select("doc_id", "row", "text", "runs")
    second = _answered(_finer(at_row(_runs(first)), length, False))
    third = _answered(_finer(at_row(_runs(second)), length, True))
    # the windows of a text as few stretches: bounded by its length
    every = _spans(first).unionByName(_spans(second)).unionByName(_spans(third))
    spans = every.groupBy(F.col("row").alias("run_row")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def kernel(batches):
        for rb in util.slices(batches, "text", _CHUNK):
            raw, off = util.buffers(rb.column("text"))
            runs = rb.column("runs")
            removed, n_spans, digest = [], [], []
            for i in range(rb.num_rows):
                one = raw[off[i] : off[i + 1]]
                gone = np.zeros(len(one) + 1, np.int32)
                r = runs[i].values
                if r is not None and len(r):
                    np.add.at(gone, r.field("lo").to_numpy(), 1)
                    np.add.at(gone, r.field("hi").to_numpy() + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(one[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rb.column("doc_id"), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            )

    return texts.join(spans, texts["row"] == spans["run_row"], "left").select("doc_id", "row", "text", "runs").mapInArrow(kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same for DuckDB: every window by itself.
SQL = """WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
 p AS (SELECT doc_id, h, n, unnest(range(0, n, 1000)) AS q FROM t WHERE n >= 200), z AS (SELECT doc_id, q, n, substr(h, 2 * q + 1, 2400) AS x FROM p),
 w AS (SELECT doc_id, q + j AS i, md5(substr(x, 2 * j + 1, 400)) AS m FROM (SELECT doc_id, q, n, x, unnest(range(0, 1000)) AS j FROM z) WHERE q + j <= n - 200),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
 g AS (SELECT doc_id, i, sum(CASE WHEN i - b <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r)),
 s AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
 k AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS x FROM s JOIN t ON t.doc_id = s.doc_id),
 o AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(x, '' ORDER BY a) AS x, max(b) AS last FROM k GROUP BY 1)
 SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN o ON o.doc_id = t.doc_id"""


def op4_repeated_strings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts and items are words (runs of letters, digits and non-ASCII characters; A-Z lowered) and overlapping shingles
of five words (an item of fewer words is one shingle).  A window of an item's length is fingerprinted from its
shingles, each weighted by how often the window holds it.  Fingerprints of one length are cut into four blocks of
16 bits: two that differ in at most RADIUS bits agree on some block up to RADIUS // 4 bits, so looking up each block
in a table of all such neighbours finds every fingerprint within the radius.  Four tables serve items of all lengths:
items are numbered by length, so a block's neighbours of one length lie side by side.  A candidate counts if the weighted
Jaccard similarity of the shingles, computed exactly, reaches the threshold.  A text of fewer words than the item is
its own one window.

Only windows that hold at least one shingle of the benchmark are fingerprinted: all others have similarity 0.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import util

SHINGLE = 5
THRESHOLD = 0.8
#: Bits.  At similarity 0.8 fingerprints differ in 9.7 bits of 64 on average, with a deviation of 2.9.
RADIUS = 19
#: Items that one pass over the documents holds; more items make more passes, so what is broadcast is bounded.
ITEMS_A_PASS = 2000
#: Candidate pairs that are compared at once.
PAIRS = 1 << 20

_IS_WORD = np.array([b >= 128 or 48 <= b < 58 or 97 <= b < 123 for b in range(256)])
_BITS = np.arange(64, dtype=np.uint64)
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_NEAR = np.flatnonzero(_POP16 <= RADIUS // 4)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets by text)."""
    raw, off = util.buffers(column)
    low, off = util.separated(raw, off, lower=True)
    raw = np.frombuffer(low, np.uint8)
    starts, ends = util.starts_ends(_IS_WORD[raw], off)
    return util.word_hashes(raw, starts, ends), np.searchsorted(starts, off)


def signs(h: np.ndarray) -> np.ndarray:
    return (((util.mix(h + np.uint64(99))[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1


def pack(total: np.ndarray) -> np.ndarray:
    return ((total > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


class Items:
    """The items of one pass: shingles, fingerprints and the block tables."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        found = []  # (words, number in ids, shingles), read in slices of bounded size
        batch = pa.RecordBatch.from_pydict({"i": pa.array(range(len(ids)), pa.int64()), "text": pa.array(texts, pa.string())})
        for rb in util.slices([batch], "text"):
            h, off = words_of(rb.column("text"))
            for i, a, z in zip(rb.column("i").to_pylist(), off, off[1:]):
                k = min(SHINGLE, int(z - a))
                if k:
                    found.append((int(z - a), i, util.grams(h, np.arange(a, z - k + 1), k)))
        found.sort(key=lambda x: x[:2])
        self.ids = [ids[i] for _, i, _ in found]
        self.length = np.array([n for n, _, _ in found], np.int64)
        self.size = np.minimum(self.length, SHINGLE)
        self.shingles = [x for _, _, x in found]
        self.weights = lru_cache(256)(lambda i: Counter(self.shingles[i].tolist()))
        self.prints = np.array([pack(signs(s).sum(0)[None])[0] for s in self.shingles], np.uint64)
        self.known = {k: np.unique(np.concatenate([x for x, s in zip(self.shingles, self.size) if s == k])) for k in sorted({int(s) for s in self.size})}
        self.filter = {k: np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(bool) for k, v in self.known.items()}
        self.tables = [self._table(b) for b in range(4)]

    def _blocks(self, prints: np.ndarray, b: int) -> np.ndarray:
        """Block b of each fingerprint as the first key that a table may have for it."""
        kind = np.uint32 if len(self.ids) < 1 << 16 else np.uint64
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(kind) * kind(len(self.ids))

    def _table(self, b: int) -> np.ndarray:
        """neighbour * items + item, in order, for all neighbours of the items' blocks: 2517 numbers an item."""
        own = self._blocks(self.prints, b)
        n = own.dtype.type(max(1, len(self.ids)))
        keys = (own[:, None] // n ^ _NEAR.astype(own.dtype)) * n + np.arange(len(own), dtype=own.dtype)[:, None]
        keys = keys.ravel()
        keys.sort()
        return keys

    def holds(self, h: np.ndarray, k: int) -> np.ndarray:
        """Which shingle hashes some item has."""
        maybe = np.flatnonzero(self.filter[k][(h >> np.uint64(44)).astype(np.int64)])
        v = self.known[k]
        at = np.minimum(np.searchsorted(v, h[maybe]), len(v) - 1)
        return maybe[v[at] == h[maybe]]

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of length n within the radius, all of them."""
        first, last = np.searchsorted(self.length, [n, n + 1])
        if first == last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = []
        for b, keys in enumerate(self.tables):
            low = self._blocks(prints, b)
            spans.append((np.searchsorted(keys, low + low.dtype.type(first)), np.searchsorted(keys, low + low.dtype.type(last - 1), side="right")))
        total = np.cumsum(sum(z - a for a, z in spans))
        cuts = np.searchsorted(total, np.arange(0, int(total[-1]) + PAIRS, PAIRS)) if len(prints) else []
        w, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts, [*cuts[1:], len(prints)]):
            if hi > lo:
                got = self._near(prints[lo:hi], [(a[lo:hi], z[lo:hi]) for a, z in spans])
                w.append(got[0] + lo)
                i.append(got[1])
        return np.concatenate(w), np.concatenate(i)

    def _near(self, prints: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
        pair = []
        for keys, (a, z) in zip(self.tables, spans):
            size = z - a
            total = np.cumsum(size) - size
            item = keys[np.repeat(a - total, size) + np.arange(int(size.sum()))] % keys.dtype.type(len(self.ids))
            pair.append(np.repeat(np.arange(len(prints)), size) * len(self.ids) + item.astype(np.int64))
        pair = np.unique(np.concatenate(pair))
        w, i = pair // len(self.ids), pair % len(self.ids)
        x = prints[w] ^ self.prints[i]
        d = sum(_POP16[((x >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for b in range(4))
        return w[d <= RADIUS], i[d <= RADIUS]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def leaks_of(items: Items, h: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(text, item, first word of the best window, similarity) of each leak in the texts."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    if not len(h) or not items.ids:
        return []
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for k in items.known:
        m = len(h) - k + 1
        if m <= 0:
            continue
        begin = np.flatnonzero(doc[:m] == doc[k - 1 :])
        shingle = util.grams(h, begin, k)
        hits = begin[items.holds(shingle, k)]
        if not len(hits):
            continue
        held = np.unique(doc[hits])
        words = off[held + 1] - off[held]
        for n in sorted({int(x) for x, s in zip(items.length, items.size) if s == k}):
            # shorter texts, each as one window; with fewer shingles than this none reaches the threshold
            short = held[(words < n) & ((words - k + 1) / (n - k + 1) >= threshold)]
            if len(short):
                own = [util.grams(h, np.arange(off[d], off[d + 1] - k + 1), k) for d in short]
                for w, i in zip(*items.near(np.array([pack(signs(x).sum(0)[None])[0] for x in own], np.uint64), n)):
                    s = similarity(Counter(own[w].tolist()), items.weights(int(i)))
                    key = (int(short[w]), int(i))
                    if s >= threshold and s > best.get(key, (0.0, 0))[0]:
                        best[key] = (s, 0)
            # all windows of n words with a hit inside, piece by piece
            lo = np.maximum(hits - (n - k), off[doc[hits]])
            hi = np.minimum(hits, off[doc[hits] + 1] - n)
            lo, hi = lo[hi >= lo], hi[hi >= lo]
            if not len(lo):
                continue
            lo[1:] = np.maximum(lo[1:], np.maximum.accumulate(hi)[:-1] + 1)
            size = np.maximum(hi - lo + 1, 0)
            starts = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            for part in np.array_split(starts, max(1, len(starts) // 20_000)):
                if not len(part):
                    continue
                # the shingles under the windows, each once
                need = np.unique((part[:, None] + np.arange(n - k + 1)).ravel()) if len(part) < 64 else _span(part, n - k + 1)
                hash_ = util.grams(h, need, k)
                total = np.zeros((len(need) + 1, 64), np.int32)
                np.cumsum(signs(hash_), axis=0, out=total[1:])
                a = np.searchsorted(need, part)
                prints = pack(total[a + n - k + 1] - total[a])
                for w, i in zip(*items.near(prints, n)):
                    s = similarity(Counter(hash_[a[w] : a[w] + n - k + 1].tolist()), items.weights(int(i)))
                    if s >= threshold:
                        key = (int(doc[part[w]]), int(i))
                        if key not in best or s > best[key][0]:
                            best[key] = (s, int(part[w] - off[key[0]]))
    return [(d, i, at, s) for (d, i), (s, at) in sorted(best.items())]


def _span(part: np.ndarray, n: int) -> np.ndarray:
    """All positions from each start (ascending) to n on, once."""
    first = part.copy()
    first[1:] = np.maximum(part[1:], part[:-1] + n)
    size = part + n - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _passes(benchmark: DataFrame, a_pass: int) -> list[tuple[list[int], list[str]]]:
    """The items in bounded parts; items come to the driver one part at a time."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text is not null and item_id is not null")
    total = rows.count()
    if total <= a_pass:
        got = [(r.item_id, r.text) for r in rows.collect()]
        return [([i for i, _ in sorted(got)], [t for _, t in sorted(got)])] if got else []
    out = []
    n = -(-total // (a_pass // 2))
    for p in range(n):
        got = sorted((r.item_id, r.text) for r in rows.where(f"pmod(xxhash64(item_id, text), {n}) = {p}").collect())
        for s in range(0, len(got), a_pass):
            out.append(([i for i, _ in got[s : s + a_pass]], [t for _, t in got[s : s + a_pass]]))
    return out


_BUILT: dict[str, Items] = {}


def _items(name: str, ids: list[int], texts: list[str]) -> Items:
    """The items of a pass, built once by each Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(ids, texts)
    return _BUILT[name]


SCHEMA = "doc_id long, item_id long, first_word long, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """One row per document and item that it leaks: the best window's first word and its similarity.

    Null and empty texts and items leak nothing; repeated rows give repeated rows; among equal windows the first
    counts.  Texts are read whole, batch by batch; nothing is shuffled.
    """
    util.ship(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for ids, texts in _passes(benchmark, a_pass):

        def kernel(batches, ids=ids, texts=texts, name=uuid.uuid4().hex):
            items = _items(name, ids, texts)
            for rb in util.slices(batches, "text"):
                h, off = words_of(rb.column("text"))
                got = leaks_of(items, h, off, threshold)
                doc = rb.column("doc_id").cast(pa.int64()).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": doc, "item_id": pa.array([items.ids[g[1]] for g in got], pa.int64()), "first_word": pa.array([g[2] for g in got], pa.int64()), "similarity": pa.array([g[3] for g in got], pa.float64())})

        out = out.unionByName(util.need(docs, "doc_id", "text").mapInArrow(kernel, SCHEMA))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The documents that leak no item, all columns as they are; judged row by row."""
    util.ship(docs.sparkSession)
    for ids, texts in _passes(benchmark, a_pass):

        def kernel(batches, ids=ids, texts=texts, name=uuid.uuid4().hex):
            items = _items(name, ids, texts)
            for rb in util.slices(batches, "text"):
                h, off = words_of(rb.column("text"))
                clean = np.ones(rb.num_rows, bool)
                clean[[g[0] for g in leaks_of(items, h, off, threshold)]] = False
                yield rb.filter(pa.array(clean))

        docs = docs.mapInArrow(kernel, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

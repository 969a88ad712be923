"""What the corpus operators share: Arrow batches as byte arrays, rolling hashes, shared folders."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that a kernel works on at once; one longer text is a chunk of its own.
CHUNK = 1_000_000
#: Bytes of an Arrow batch between Spark and a Python worker, unless the session sets its own.
BATCH = "4m"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: they may not share the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_hitgraph_shipped", False):
        return
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "hitgraph_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(os.path.join(root, "hitgraph")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    sc.addPyFile(path)
    sc._hitgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names (set only where it is unset)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "hitgraph-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hitgraph-{uuid.uuid4().hex}"


def persist(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that a kernel no longer holds back to the machine: Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Just these columns; extra ones, whatever their names, do not disturb an operator."""
    return df.select(*[df[c] for c in cols])


def slices(batches: Iterable[pa.RecordBatch], col: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part hold at most so many bytes (or are one text)."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        sizes = pc.binary_length(rb.column(col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at, start = np.cumsum(sizes), 0, 0
        while start < rb.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, at + most, side="right")))
            yield rb.slice(start, stop - start)
            at, start = int(ends[stop - 1]), stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def separated(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[bytes, np.ndarray]:
    """The texts with a \\n after each, and where each begins; A-Z lowered if asked for."""
    whole = raw.tobytes()
    whole = whole.translate(ASCII_LOWER) if lower else whole
    at = off.tolist()
    return b"\n".join([*(whole[a:b] for a, b in zip(at, at[1:])), b""]), off + np.arange(len(off))


def counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set between the offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def starts_ends(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that are inside, none over a text's edge."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POW:
        _POW.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.ones(size + 1, U64)
            p[1:] = U64(b)
            out.append(np.multiply.accumulate(p))
        _POW[size] = (out[0], out[1])
    return _POW[size]


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.pow, self.inv = powers(self.n + 1)
        self.sum = np.zeros(self.n + 1, U64)
        np.cumsum(values * self.pow[: self.n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(U64))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end) of the bytes; a long word's is a digest, as sums of powers meet there."""
    if not len(start):
        return np.zeros(0, U64)
    out = Rolling(_BYTE[raw]).of(start, end)
    for k in np.flatnonzero(end - start > 256).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position of `first` (which leaves n words)."""
    h = np.zeros(len(first), U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * U64(0x9FB21C651E98DF25) + words[first + k] + U64(k + 1))
    return h

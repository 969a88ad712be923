"""Quality rules: statistics of whole documents, scored by boosted trees, beside fixed base rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, util

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name, sign of its constraint: with -1 a larger value never raises the quality score.
FEATURES = (("words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("capitals", -1), ("marks", -1), ("digits", -1), ("letters", 0), ("line_words", 0), ("longest_word", 0))
#: Labelled rows that the trees are fitted on at most: a bound on what reaches the driver, not on what is scored.
FIT_ROWS = 20_000


def statistics(rb: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base counts, features) of each text."""
    raw, off = util.buffers(rb.column("text"))
    whole, off = util.separated(raw, off)
    raw = np.frombuffer(whole, np.uint8)
    n = len(off) - 1
    inside = ~_SPACE[raw]
    starts, ends = util.starts_ends(inside, off)
    first = np.searchsorted(starts, off)
    n_words = np.diff(first)
    chars = util.counts(inside & ((raw & 0xC0) != 0x80), off)
    symbols = util.counts(_SYMBOL[raw], off)

    dup_lines, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = off.tolist()
    for d in range(n):
        seen: set[bytes] = set()
        mine = [x for x in whole[at[d] : at[d + 1] - 1].split(b"\n") if x and not x.isspace()]
        seen.update(mine)
        lines[d], dup_lines[d] = len(mine), len(mine) - len(seen)

    doc = np.repeat(np.arange(n), n_words)
    hashes = util.word_hashes(raw, starts, ends)
    repeat = repeated_words(hashes, doc, first, 8)
    n_repeat = util.counts(repeat, first)

    w = np.maximum(n_words, 1)
    c = np.maximum(chars, 1)
    alpha = np.maximum(util.counts(_ALPHA[raw] & ((raw & 0xC0) != 0x80), off), 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, ends - starts)
    marks = util.counts((raw == 33) | (raw == 63), off)
    x = np.stack(
        [
            np.minimum(n_words, 2000), chars / w, symbols / w, dup_lines / np.maximum(lines, 1), n_repeat / w,
            util.counts(_UPPER[raw], off) / alpha, marks / w, util.counts(_DIGIT[raw], off) / c, alpha / c,
            np.minimum(n_words / np.maximum(lines, 1), 400), np.minimum(longest, 200),
        ],
        1,
    ).astype(float)
    return dict(zip(COUNTS, (n_words, chars, symbols, dup_lines, n_repeat))), x


def repeated_words(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of `size` words that their text has twice or more."""
    out = np.zeros(len(hashes), bool)
    m = len(hashes) - size + 1
    if m <= 0:
        return out
    begin = np.flatnonzero(doc[:m] == doc[size - 1 :])
    if not len(begin):
        return out
    key = util.grams(hashes, begin, size) ^ util.mix(doc[begin].astype(np.uint64) + np.uint64(77))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    hit = begin[order[same]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return np.cumsum(edge[:-1]) > 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = 0.995) -> tuple[boosting.Forest, float]:
    """(trees, cut): fitted on at most fit_rows labelled documents, a fifth of them held out for the cut.

    The cut is at most the (1-keep) quantile of the held-out good documents' scores, so clean documents stay.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    ids = chosen.toPandas()
    if ids.empty:
        return boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), np.array([s for _, s in FEATURES])), -np.inf
    small = spark.createDataFrame(ids)

    def kernel(batches):
        for rb in util.slices(batches, "text"):
            _, x = statistics(rb)
            cols = {"doc_id": rb.column("doc_id").cast(pa.int64()), "quality": rb.column("quality")}
            yield pa.RecordBatch.from_pydict(cols | {f"f{j}": pa.array(x[:, j]) for j in range(x.shape[1])})

    schema = "doc_id long, quality double, " + ", ".join(f"f{j} double" for j in range(len(FEATURES)))
    # the sample is bounded by fit_rows, so this side is safe to broadcast
    rows = util.need(docs, "doc_id", "text").join(F.broadcast(small), "doc_id").mapInArrow(kernel, schema)
    # of one doc_id's rows one reaches the driver
    each = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *[f"f{j}" for j in range(len(FEATURES))])).alias("r")).select("doc_id", "r.*")
    pdf = each.toPandas().sort_values("doc_id").reset_index(drop=True)
    x, y = pdf[[f"f{j}" for j in range(len(FEATURES))]].to_numpy(float), pdf["quality"].to_numpy(float)
    signs = np.array([s for _, s in FEATURES])
    held = np.arange(len(x)) % 5 == 4
    trees = boosting.fit(x[~held], y[~held], signs)
    good = np.sort(trees.score(x[held & (y > 0.5)])) if (held & (y > 0.5)).any() else np.array([0.0])
    return trees, float(min(0.0, good[int((1 - keep) * len(good))]))


def rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: base counts, base_failed, the trees' score and kept.

    Null and empty texts have 0 words and fail the base rules; repeated rows give repeated rows; without labels
    the trees keep everything.  Texts are read whole, batch by batch, without a shuffle.
    """
    util.ship(docs.sparkSession)
    trees, cut = train(docs, labels, fit_rows)

    def kernel(batches):
        for rb in util.slices(batches, "text"):
            base, x = statistics(rb)
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            score = trees.score(x)
            cols = {"doc_id": rb.column("doc_id").cast(pa.int64())} | {c: pa.array(base[c], pa.int64()) for c in COUNTS}
            yield pa.RecordBatch.from_pydict(cols | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= cut)), "score": pa.array(1 / (1 + np.exp(-score)))})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return util.need(docs, "doc_id", "text").mapInArrow(kernel, schema)


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the rules keep, all columns as they are; judged row by row, so no join and no shuffle."""
    util.ship(docs.sparkSession)
    trees, cut = train(docs, labels, fit_rows)

    def kernel(batches):
        for rb in util.slices(batches, "text"):
            base, x = statistics(rb)
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            yield rb.filter(pa.array(~failed & (trees.score(x) >= cut)))

    return docs.mapInArrow(kernel, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

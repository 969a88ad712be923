import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from hitgraph.llm import resampling

from .fixtures import TEXTS, documents


def brute(docs, target, percent=10, least=20, most=1, buckets=10_000):
    """{doc_id: (n_features, weight, score, rank)} from the definition."""

    def feats(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    mine = {d: feats(t) for d, t in docs}
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, f in mine.values():
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, feats(x)[1], 1)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out = {}
    for d, (n, f) in mine.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    may = sorted((d for d in out if mine[d][0] >= least), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(may[: percent * len(may) // 100]):
        out[d][3] = k + 1
    return {d: tuple(x) for d, x in out.items()}


def found(spark, docs, target, **how):
    aim = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, aim, **how).collect()}


TARGET = ["words of the benchmark stand here", None, "", "one a b c License"]


def test_awkward_texts(spark):
    texts = [*TEXTS, "x" * 100_000 + " word", "ab " * 70_000, "é" * 30 + " É", "words of the benchmark " * 20]
    assert found(spark, documents(spark, texts), TARGET, percent=60) == brute(list(enumerate(texts)), TARGET, percent=60)


@pytest.mark.parametrize("most", [2, 3])
def test_runs_of_words(spark, most):
    texts = [t for t in TEXTS if t is None or len(t) < 2000]
    assert found(spark, documents(spark, texts), TARGET, percent=50, least_words=3, most=most, buckets=97) == brute(list(enumerate(texts)), TARGET, 50, 3, most, 97)


def test_whole_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    aim = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.op12_importance_resampling(spark, sf).collect()}
    assert got == brute(rows, aim)


def test_small_batches_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BATCH_BYTES", 500)
    rng = random.Random(2)
    texts = ["the the the " + " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(40))) for _ in range(300)]
    assert found(spark, documents(spark, texts), TARGET) == brute(list(enumerate(texts)), TARGET)


def test_empty_tables_and_null_ids(spark):
    assert found(spark, documents(spark, []), TARGET) == {}
    docs = spark.createDataFrame([(None, "a b " * 20), (1, "a b " * 20), (2, "c d " * 20), (2, "c d " * 20)], "doc_id long, text string")
    rows = resampling.resample(docs, spark.createDataFrame([], "item_id long, text string"), percent=100).collect()
    assert len(rows) == 4
    assert [r for r in rows if r.doc_id is None][0].score is None
    assert sorted(r["rank"] for r in rows if r.doc_id is not None) == [1, 2, 3]


def test_checksums_go_on_from_a_state():
    raw = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    start, end = np.array([0, 3, 5, 0, 7]), np.array([0, 4, 160, 48, 56])
    got = resampling.crc(raw, start, end, np.full(5, zlib.crc32(b"before"), np.uint32))
    assert got.tolist() == [zlib.crc32(b"before" + raw[a:b].tobytes()) for a, b in zip(start, end)]

"""Importance resampling towards a target text by bucket-partitioned inverted postings.

Texts become postings: for each bucket of hashed word runs the documents that hold it, and how often.  They are dealt
out by bucket; beside them go the bucket's counts in the corpus and in the target, from which its gain is computed
where its postings are.  What leaves is a contribution by document, which one more exchange adds up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import util

BUCKETS = 10_000
#: Documents and bytes of text of a batch: the unit in which postings are packed (numbers in it have 16 bits).
BATCH_DOCS, BATCH_BYTES = 1 << 15, 64 << 20
#: Shares into which a bucket's postings are dealt, so that a bucket that all documents hold is no one task's.
SALTS = 16
#: Bytes of a word that are hashed in step with other words; longer words are hashed alone.
LONG = 48

_TABLE = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_i] = _c
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc(raw: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches, each going on from a state (the checksum of what stands before it)."""
    out = ~state
    size = end - start
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    long = int(np.searchsorted(-size[order], -LONG, side="left"))
    for k in order[:long].tolist():
        out[k] = ~np.uint32(zlib.crc32(raw[start[k] : end[k]].tobytes(), int(state[k])))
    order = order[long:]
    first, size, c = start[order], size[order], out[order]
    for p in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -p, side="left"))  # those longer than p
        c[:n] = _TABLE[(c[:n] ^ raw[first[:n] + p]) & 255] ^ (c[:n] >> np.uint32(8))
    out[order] = c
    return ~out


def features(raw: np.ndarray, off: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, its bucket) for runs of 1 to `most` words of lower-cased texts."""
    start, end = util.starts_ends(_INSIDE[raw], off)
    text = np.searchsorted(off, start, side="right") - 1
    n_words = np.bincount(text, minlength=len(off) - 1)
    state = np.zeros(len(start), np.uint32)
    texts, found = [], []
    space = np.frombuffer(b" ", np.uint8)
    at = np.arange(len(start))
    for run in range(most):
        if run:  # each run takes one more word, if its text has one
            fits = at + run < len(start)
            at, state = at[fits], state[fits]
            fits = text[at] == text[at + run]
            at, state = at[fits], state[fits]
            state = crc(space, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), state)
        state = crc(raw, start[at + run], end[at + run], state)
        texts.append(text[at])
        found.append((state % np.uint32(buckets)).astype(np.int64))
    return n_words, np.concatenate(texts), np.concatenate(found)


def postings(docs: DataFrame, id_col: str, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Written rows of two kinds.  bucket null: a batch's documents (ids, words, features); else: a bucket in a batch.

    A posting list is a row: `doc` has the documents' places in the batch as 16-bit numbers, `times` the counts
    (a count over 16 bits takes more entries), `total` their sum.  One job writes both, so they fit each other.
    """

    def kernel(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        words, sizes, keys, times = [], [], [], []
        docs_in = bytes_in = 0

        def flush():
            nonlocal seq, docs_in, bytes_in
            batch = (part << 28) + seq
            key, n = np.concatenate(keys), np.concatenate(times)
            while (n > 65535).any():
                over = n > 65535
                key, n = np.concatenate([key, key[over]]), np.concatenate([np.where(over, 65535, n), n[over] - 65535])
            order = np.argsort(key, kind="stable")  # by bucket, then place
            bucket, place, n = key[order] // BATCH_DOCS, (key[order] % BATCH_DOCS).astype("<u2"), n[order]
            names, first = np.unique(bucket, return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            n = n.astype("<u2")
            cut = [*first.tolist(), len(key)]
            doc = [place[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            count = [n[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            rows = len(names) + 1
            none = [None] * (rows - 1)
            out = pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([batch] * rows, pa.int64()), "bucket": pa.array([None, *names.tolist()], pa.int32()), "total": pa.array([None, *total.tolist()], pa.int64()),
                    "doc": pa.array([None, *doc], pa.binary()), "times": pa.array([None, *count], pa.binary()),
                    "ids": pa.array([ids, *none], pa.list_(pa.int64())), "n_words": pa.array([np.concatenate(words), *none], pa.list_(pa.int64())), "n_features": pa.array([np.concatenate(sizes), *none], pa.list_(pa.int64())),
                }
            )
            seq, docs_in, bytes_in = seq + 1, 0, 0
            ids.clear()
            for x in (words, sizes, keys, times):
                x.clear()
            return out

        for rb in util.slices(batches, "text"):
            for at in range(0, rb.num_rows, BATCH_DOCS):
                one = rb.slice(at, BATCH_DOCS)
                if docs_in and (docs_in + one.num_rows > BATCH_DOCS or bytes_in >= BATCH_BYTES):
                    yield flush()
                raw, off = util.buffers(one.column("text"))
                raw = np.frombuffer(raw.tobytes().translate(util.ASCII_LOWER), np.uint8)
                n_words, text, bucket = features(raw, off, most, buckets)
                key, n = np.unique(bucket * BATCH_DOCS + text + docs_in, return_counts=True)
                keys.append(key)
                times.append(n)
                ids.extend(one.column("id").to_pylist())
                words.append(n_words)
                sizes.append(np.bincount(text, minlength=one.num_rows))
                docs_in, bytes_in = docs_in + one.num_rows, bytes_in + len(raw)
        if docs_in:
            yield flush()

    schema = "batch long, bucket int, total long, doc binary, times binary, ids array<long>, n_words array<long>, n_features array<long>"
    return util.persist(docs.select(docs[id_col].cast("long").alias("id"), docs["text"].alias("text")).mapInArrow(kernel, schema))


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, target_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs; written.

    weight is the floored mean of the gains of the document's features, 0 without features.
    """
    spark = docs.sparkSession
    util.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    corpus = postings(docs, "doc_id", most, buckets)
    aim = target.select(F.lit(0).alias("id"), target["text"].alias("text"))
    totals = lambda table: table.where("bucket is not null").groupBy("bucket").agg(F.sum("total").alias("n"))
    s = totals(corpus).select("bucket", F.col("n").alias("s"))
    t = totals(postings(aim, "id", most, buckets)).select("bucket", F.col("n").alias("t"))
    both = util.persist(s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")))  # at most `buckets` rows
    all_s = both.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    all_t = t.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]

    # a bucket's counts go to each share of its postings, and stand before them there
    salted = both.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(-1).cast("long").alias("batch"), "s", "t", F.lit(None).cast("binary").alias("doc"), F.lit(None).cast("binary").alias("times"))
    none = F.lit(None).cast("long")
    lists = corpus.where("bucket is not null").select("bucket", F.pmod(F.xxhash64("batch"), F.lit(SALTS)).cast("int").alias("salt"), "batch", none.alias("s"), none.alias("t"), "doc", "times")
    dealt = salted.unionByName(lists).repartition(parts, "bucket", "salt").sortWithinPartitions("batch", "bucket")

    def contribute(batches):
        gain: dict[int, int] = {}
        now, held = -1, None  # the batch whose contributions are being added up

        def out():
            use = np.flatnonzero(held)
            return pa.RecordBatch.from_pydict({"batch": pa.array([now], pa.int64()), "doc": pa.array([use.astype("<u2").tobytes()], pa.binary()), "sums": pa.array([held[use].astype("<i8").tobytes()], pa.binary())})

        for rb in batches:
            bucket, batch = rb.column("bucket").to_pylist(), rb.column("batch").to_pylist()
            own_s, own_t = rb.column("s").to_pylist(), rb.column("t").to_pylist()
            doc, times = rb.column("doc"), rb.column("times")
            for i, (b, at) in enumerate(zip(bucket, batch)):
                if at < 0:
                    gain[b] = int(np.floor(1000 * np.log(float((own_t[i] + 1) * (all_s + buckets)) / float((own_s[i] + 1) * (all_t + buckets)))))
                    continue
                if at != now:
                    if held is not None:
                        yield out()
                    now, held = at, np.zeros(BATCH_DOCS, np.int64)
                # in one list a place stands once, but for counts over 16 bits: those of one place follow each other
                np.add.at(held, np.frombuffer(doc[i].as_buffer(), "<u2"), np.frombuffer(times[i].as_buffer(), "<u2").astype(np.int64) * gain[b])
        if held is not None:
            yield out()

    sums = dealt.mapInArrow(contribute, "batch long, doc binary, sums binary")
    blank = F.lit(None).cast("array<long>")
    sums = sums.select("batch", F.lit(1).alias("kind"), "doc", "sums", blank.alias("ids"), blank.alias("n_words"), blank.alias("n_features"))
    nil = F.lit(None).cast("binary")
    heads = corpus.where("bucket is null").select("batch", F.lit(0).alias("kind"), nil.alias("doc"), nil.alias("sums"), "ids", "n_words", "n_features")
    met = heads.unionByName(sums).repartition(parts, "batch").sortWithinPartitions("batch", "kind")

    def reduce(batches):
        head, total = None, None

        def out():
            n_words, n = head[1], head[2]
            return pa.RecordBatch.from_arrays([head[0], pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(np.where(n > 0, total[: len(n)] // np.maximum(n, 1), 0), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

        for rb in batches:
            kind = rb.column("kind").to_pylist()
            for i, k in enumerate(kind):
                if k == 0:
                    if head is not None:
                        yield out()
                    one = rb.slice(i, 1)
                    head = (one.column("ids").flatten(), one.column("n_words").flatten().to_numpy(), one.column("n_features").flatten().to_numpy())
                    total = np.zeros(BATCH_DOCS, np.int64)
                else:
                    total[np.frombuffer(rb.column("doc")[i].as_buffer(), "<u2")] += np.frombuffer(rb.column("sums")[i].as_buffer(), "<i8")
        if head is not None:
            yield out()

    return util.persist(met.mapInArrow(reduce, "doc_id long, n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null unless the row is drawn.

    Without replacement by Gumbel scores: weight plus noise from a hash of the seed and doc_id.  Drawn are
    `percent` of the rows with `least_words` or more, of highest score; ties go to the smaller doc_id, then to fewer
    features.  Null and empty texts have no features (weight 0).  Repeated rows are rows of their own; rows without
    doc_id have no score, count in the corpus and are not drawn.  Empty tables are no error on either side.

    Ranks come from one range shuffle and a count by part.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = weights(docs, target, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("may", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    drawn = scored.where("may").count() * percent // 100
    order = [F.desc("may"), F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    placed = util.persist(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counted = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(counted.select("part", (before - F.col("first") + 1).alias("shift")))  # a row for each shuffle partition
    ranked = placed.join(shift, "part").withColumn("rank", F.col("at") + F.col("shift"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 byte by byte over the distinct words.
SQL = r"""
with recursive table_(i, v, k) as (
  select i, i::bigint, 0 from range(256) r(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, k + 1 from table_ where k < 8
), tbl as (select list(v order by i) as t from table_ where k = 8),
dw as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) as w from documents),
bw as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) as w from benchmark),
words as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
codes as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || substr(x, 2 * j + 1, 2))::bigint for j in range(len(x) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
  from words, tbl
), s as (select bucket, count(*) as n from dw join codes using (w) group by bucket), t as (select bucket, count(*) as n from bw join codes using (w) group by bucket),
g as (
  select s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select sum(n) from s) + 10000))::double / ((s.n + 1) * (coalesce((select sum(n) from t), 0) + 10000))::double))::bigint as gain
  from s left join t using (bucket)
), m as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from dw join codes using (w) join g using (bucket) group by doc_id),
d as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from documents left join m using (doc_id)
), r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as eligible from d where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * eligible // 100 then place end as rank from d left join r using (doc_id)
"""

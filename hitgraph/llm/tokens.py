"""Token-ID output: whole texts encoded by a public tokenizer, written as coded blocks, read back by blocks."""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, util

#: A block is closed when it holds so many ids; one longer document is a block of its own.
BLOCK_IDS = 1 << 19
LANES = 4096
#: Words whose ids a worker remembers, some 60 bytes each, between two batches; then it forgets all.
MOST_WORDS = 1_000_000
#: Letters of a word that goes through the library in a call of its own.
LONG = 64
#: Masks of a word's first bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: Classes of Latin-1 characters in lower case: 0 white space, 1 letter, 2 number, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_KIND[[*range(9, 14), 32, 0x85, 0xA0]] = 0


class Encoder:
    """A tokenizer whose words are encoded once each.

    Texts of Latin-1 characters without special strings are cut into words here, exactly as the file's own
    pre-tokenizer does it, and each new word goes through the library; all other texts go through it whole.
    """

    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_words = norm == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == self._SPLIT and steps[0].get("invert") is True
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.forget()

    def forget(self) -> None:
        """Words of up to 16 bytes are known by those bytes in a table with open addressing, longer ones in a dict."""
        self.slot = np.full(1 << 16, -1, np.int32)
        self.known = 0
        self.low, self.high, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint8)
        self.flat, self.begin = np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def key(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of words of up to 16 bytes, as two numbers each; raw has 16 bytes more behind the last word."""
        eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
        return eight[start] & _FIRST[np.minimum(size, 8)], eight[start + 8] & _FIRST[np.maximum(size, 8) - 8]

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones; the bytes themselves are compared."""
        mask = len(self.slot) - 1
        at = (util.mix(low ^ util.mix(high + size.astype(np.uint64))) & np.uint64(mask)).astype(np.int64)
        out = self.slot[at]
        other = lambda k, i: (k >= 0) & ((self.low[k] != low[i]) | (self.high[k] != high[i]) | (self.size[k] != size[i]))
        again = np.flatnonzero(other(out, slice(None)))
        while len(again):
            at[again] = (at[again] + 1) & mask
            got = self.slot[at[again]]
            out[again] = got
            again = again[other(got, again)]
        return out

    def insert(self, number: np.ndarray) -> None:
        mask = len(self.slot) - 1
        at = (util.mix(self.low[number] ^ util.mix(self.high[number] + self.size[number].astype(np.uint64))) & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(number))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.slot[at[won]] = number[won]
            lost = np.ones(len(number), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & mask

    def add(self, words: list[bytes]) -> np.ndarray:
        """Numbers for words that are all new and all different; they go through the library, once each."""
        flat, size = self.through_library([w.decode("latin-1") for w in words])
        number = np.arange(self.known, self.known + len(words), dtype=np.int32)
        self.known += len(words)
        grown = lambda x, n: x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
        self.low, self.high, self.size = (grown(x, self.known) for x in (self.low, self.high, self.size))
        self.begin = grown(self.begin, self.known + 1)
        total = int(self.begin[self.known - len(words)])
        self.flat = grown(self.flat, total + len(flat))
        self.flat[total : total + len(flat)] = flat
        self.begin[self.known - len(words) + 1 : self.known + 1] = total + np.cumsum(size)
        return number

    def learn(self, raw: bytes, start: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        """New words of up to 16 bytes, repeated ones among them."""
        order = np.lexsort((size, high, low))
        first = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        first[1:] = (low[x] != low[y]) | (high[x] != high[y]) | (size[x] != size[y])
        one = order[first]
        number = self.add([raw[a : a + n] for a, n in zip(start[one].tolist(), size[one].tolist())])
        self.low[number], self.high[number], self.size[number] = low[one], high[one], size[one]
        if self.known * 3 > len(self.slot):
            every = np.sort(np.concatenate([self.slot[self.slot >= 0], number]))
            self.slot = np.full(1 << (self.known * 4).bit_length(), -1, np.int32)
            self.insert(every)
        else:
            self.insert(number)

    def through_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words, how many each has)."""
        # many words in one call, a number between any two: numbers are words of their own
        mark = self.library.encode("0", add_special_tokens=False).ids
        alone = [w in "0123456789²³¹¼½¾" or len(w) > LONG for w in words]
        plain = [w for w, d in zip(words, alone) if not d]
        coded = self.batch([" 0 ".join(plain[i : i + 128]) for i in range(0, len(plain), 128)], add_special_tokens=False)
        flat = np.array(list(chain.from_iterable(chain(e.ids, mark) for e in coded)), np.uint32)
        ends = np.flatnonzero(flat == mark[0])
        if len(mark) != 1 or len(ends) != len(plain):
            raise ValueError("the library cuts words otherwise")
        if not any(alone):
            return np.delete(flat, ends), np.diff(np.concatenate([[-1], ends])) - 1
        pieces = iter(np.split(flat, ends + 1))
        parts = [np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32) if d else next(pieces)[:-1] for w, d in zip(words, alone)]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number by text), without added special tokens."""
        if self.known > MOST_WORDS or len(self.flat) > 8 * MOST_WORDS or self.long_bytes > 16 * MOST_WORDS:
            self.forget()
        simple: list[bytes] = []
        odd: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            found = b""
            if t:
                try:
                    if not self.by_words or any(s in t for s in self.special):
                        raise UnicodeError
                    found = t.lower().encode("latin-1")
                except UnicodeError:
                    odd[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
            simple.append(found)
        whole = b"\n".join([*simple, b"\n" * 16])
        raw = np.frombuffer(whole, np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(x) + 1 for x in simple])])
        kind = _KIND[raw]
        begin = np.empty(len(raw) + 1, bool)
        begin[0] = begin[-1] = True
        begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quote = np.flatnonzero(raw[:-2] == 39)
        if len(quote):
            quote = quote[begin[quote]]
            one, two = raw[quote + 1], raw[quote + 2]
            n = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
            for x, y in (b"re", b"ve", b"ll"):
                n[(one == x) & (two == y)] = 2
            quote, n = quote[n > 0], n[n > 0]
            begin[quote + 1] = False
            begin[(quote + 2)[n == 2]] = False
            begin[quote + n + 1] = True
        at = np.flatnonzero(begin)
        word = kind[at[:-1]] > 0
        start, end = at[:-1][word], at[1:][word]
        size = end - start
        k = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(size <= 16)
        at, n = start[short], size[short].astype(np.uint8)
        low, high = self.key(whole, at, n)
        k[short] = self.find(low, high, n)
        new = np.flatnonzero(k[short] < 0)
        if len(new):
            self.learn(whole, at[new], low[new], high[new], n[new])
            k[short[new]] = self.find(low[new], high[new], n[new])
        rest = np.flatnonzero(size > 16)
        if len(rest):
            words = [whole[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            new = list({w: None for w in words if w not in self.long})
            if new:
                self.long.update(zip(new, self.add(new).tolist()))
                self.long_bytes += sum(map(len, new))
            k[rest] = [self.long[w] for w in words]
        size = self.begin[k + 1] - self.begin[k]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(self.begin[k] - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, edge)]
        n = np.diff(cut)
        if odd:
            parts = [odd.get(i, ids[cut[i] : cut[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, vocab: int = 49408, order: list[Column] | None = None) -> None:
    """Encode whole texts and write them to `path` as coded blocks, in ascending order of doc_id (or of `order`).

    One range shuffle puts the documents in order; ties are ordered by text.  A block's row holds its place (part,
    seq, ids of the part before it), the doc_ids and the coded ids with their checksums.  Null and empty texts are
    documents of just the end id.  Spark's own committer writes the files, so lost executors leave no partial file.
    """
    spark = docs.sparkSession
    util.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order or [docs["doc_id"]]
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")

    def kernel(batches):
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        seq = start = 0
        held: list = [[], [], []]  # doc_ids, ids, lengths

        def block():
            nonlocal seq, start
            ids = np.concatenate([*held[1], np.zeros(0, np.uint32)]).astype(np.uint32)
            doc = [d for x in held[0] for d in x]
            lengths = np.concatenate([*held[2], np.zeros(0, np.int64)])
            lanes = max(1, min(LANES, len(ids) // 128))
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([doc], pa.list_(pa.int64())), "block": pa.array([codec.encode_block(ids, lengths, vocab, lanes)], pa.binary()),
                }
            )
            seq, start = seq + 1, start + len(ids)
            for h in held:
                h.clear()
            util.release()
            return out

        size = 0
        for rb in util.slices(batches, "text", 1 << 20):
            ids, n = coder.encode(rb.column("text").to_pylist())
            if end_id is not None:
                at = np.cumsum(n)
                ids = np.insert(ids, at, end_id)
                n = n + 1
            held[0].append(rb.column("doc_id").to_pylist())
            held[1].append(ids)
            held[2].append(n)
            size += len(ids)
            if size >= BLOCK_IDS:
                yield block()
                size = 0
        if held[0]:
            yield block()

    ordered.mapInArrow(kernel, "part int, seq int, start long, n_ids long, doc_ids array<long>, block binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, part (damaged blocks raise)."""
    blocks = spark.read.parquet(path)
    sums = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each part: as many as shuffle partitions
    base, total = {}, 0
    for r in sums:
        base[r["part"]] = total
        total += r["n"]

    def kernel(batches):
        for rb in batches:
            for row in range(rb.num_rows):
                one = rb.slice(row, 1)
                ids, lengths = codec.decode_block(one.column("block")[0].as_py())
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                first = base[one.column("part")[0].as_py()] + one.column("start")[0].as_py()
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": one.column("doc_ids").flatten(), "start": pa.array(first + at[:-1], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                )

    return blocks.mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    path = util.shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer())
    return read(spark, path)

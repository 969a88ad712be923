"""Blocks of token ids by an adaptive context-mixing range coder.

A block stands alone: its models start empty and it carries checksums.  Its ids are cut into lanes of equal length
that are coded side by side, row by row, by one shared model, so each row is a handful of numpy calls.

Model: the ids seen after the last two ids (order 2, hashed) and after the last id (order 1) each predict one id
with a confidence; order 0 is an adaptive distribution over all ids.  How much of the range each gets is learned by
counting, for each pair of confidences, which of the predictions came true.  Encoder and decoder update the model
with whole rows, in the same order, in integers only, so they stay equal on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
MAGIC = b"HGT1"
_HEAD = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, vocabulary, documents, crc of ids, crc of payload, payload bytes
TOP = 24  # bits of the frequencies' total
MASK48 = U64((1 << 48) - 1)
SLOTS = 1 << 18
#: Ids between two refreshes of the order-0 distribution: so many, or an eighth of those seen.
REFRESH = 4096


class _Model:
    def __init__(self, vocab: int, lanes: int) -> None:
        self.vocab, self.lanes = vocab, lanes
        self.one, self.sure1 = np.zeros(vocab + 1, np.int32), np.zeros(vocab + 1, np.int8)
        self.two, self.sure2 = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int8)
        self.hits = np.ones((32, 3), np.int64)  # by kind of context: order 2, order 1, neither came true
        self.hits[:, 2] = 4
        self.seen = np.zeros(vocab, np.int64)
        self.fresh = self.total = 0
        self.last = np.full(lanes, vocab, np.int64)  # vocab: none yet
        self.before = np.full(lanes, vocab, np.int64)
        self.refresh()

    def refresh(self) -> None:
        floor = max(1, (1 << TOP) // (8 * self.vocab))
        left = (1 << TOP) - floor * self.vocab
        total = int(self.seen.sum())
        freq = np.full(self.vocab, floor, np.int64)
        if total:
            freq += self.seen * left // total
        freq[0] += (1 << TOP) - int(freq.sum())
        self.cum = np.zeros(self.vocab + 1, np.int64)
        np.cumsum(freq, out=self.cum[1:])
        # where each 64th of the range begins to look for its symbol
        self.look = np.repeat(np.arange(self.vocab, dtype=np.int32), np.diff((self.cum + 63) >> 6))
        # the mix, in 4096ths; order 0 keeps a 32nd at least
        share = self.hits[:, :2] * 3840 // self.hits.sum(1, keepdims=True) + 1
        self.share = share.astype(np.int64) << (TOP - 12)
        self.fresh = 0

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol whose stretch of order 0 holds each place."""
        x = self.look[at >> 6].astype(np.int64)
        more = np.flatnonzero(self.cum[x + 1] <= at)
        while len(more):
            x[more] += 1
            more = more[self.cum[x[more] + 1] <= at[more]]
        return x

    def predict(self, n: int):
        a, b = self.last[:n], self.before[:n]
        slot = (a * 40503 + b * 65599 + (b >> 3)) & (SLOTS - 1)
        p2, p1, s2, s1 = self.two[slot], self.one[a], self.sure2[slot], self.sure1[a]
        kind = s2 * 8 + s1 * 2 + (p1 == p2)
        return slot, p2, p1, kind, self.share[kind, 0], self.share[kind, 1]

    def update(self, n: int, ids, slot, p2, p1, kind) -> None:
        a = self.last[:n]
        hit2 = ids == p2
        hit1 = ids == p1
        which = np.where(hit2, 0, np.where(hit1, 1, 2))
        self.hits += np.bincount(kind * 3 + which, minlength=96).reshape(32, 3)
        s2 = self.sure2[slot]
        self.two[slot] = np.where((s2 > 1) & ~hit2, p2, ids)
        self.sure2[slot] = np.where(hit2, np.minimum(s2 + 1, 3), np.where(s2 > 1, s2 - 1, 1))
        s1 = self.sure1[a]
        self.one[a] = np.where((s1 > 1) & ~hit1, p1, ids)
        self.sure1[a] = np.where(hit1, np.minimum(s1 + 1, 3), np.where(s1 > 1, s1 - 1, 1))
        self.seen += np.bincount(ids, minlength=self.vocab) if n * 8 > self.vocab else 0
        if n * 8 <= self.vocab:
            np.add.at(self.seen, ids, 1)
        self.before[:n] = a
        self.last[:n] = ids
        self.fresh += n
        self.total += n
        if self.fresh >= max(REFRESH, self.total >> 3):
            self.refresh()


def _lanes(n: int, lanes: int | None) -> tuple[int, int, int]:
    """(lanes, rows, lanes that reach into the last row)."""
    lanes = lanes or max(1, min(1024, n // 128))
    rows = -(-n // lanes)
    return lanes, rows, n - (rows - 1) * lanes if n else 0


def _table(ids: np.ndarray, lanes: int, rows: int, full: int) -> np.ndarray:
    """Row by row what each lane codes: the first `full` lanes hold `rows` ids in a row of the block, others one less."""
    out = np.zeros((rows, lanes), np.int64)
    cut = full * rows
    out[:, :full] = ids[:cut].reshape(full, rows).T
    if rows > 1:
        out[: rows - 1, full:] = ids[cut:].reshape(lanes - full, rows - 1).T
    return out


def encode_block(ids: np.ndarray, doc_lengths: np.ndarray, vocab: int, lanes: int | None = None) -> bytes:
    """One block of the file format; doc_lengths sum to the number of ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if n and int(ids.max()) >= vocab:
        raise ValueError("an id is outside the vocabulary")
    lanes, rows, full = _lanes(n, lanes)
    model = _Model(vocab, lanes)
    table = _table(ids.astype(np.int64), lanes, rows, full) if n else np.zeros((0, lanes), np.int64)
    low, size = np.zeros(lanes, U64), np.full(lanes, MASK48, U64)
    out = np.zeros((lanes, 2 * rows + 4), np.int32)
    at = np.zeros(lanes, np.int64)
    every = np.arange(lanes)
    for r in range(rows):
        m = lanes if r < rows - 1 else full
        x = table[r, :m]
        slot, p2, p1, kind, w2, w1 = model.predict(m)
        w0 = (1 << TOP) - w2 - w1
        base = w2 + w1
        c, d = (model.cum[x] * w0) >> TOP, (model.cum[x + 1] * w0) >> TOP
        is2, is1 = x == p2, x == p1
        a = np.where(is2, 0, np.where(is1, w2, base + c))
        width = np.where(is2, w2, np.where(is1, w1, d - c))
        step = size[:m] >> U64(TOP)
        lo = low[:m] + step * a.astype(U64)
        over = lo > MASK48
        if over.any():
            k = every[:m][over]
            out[k, at[k] - 1] += 1
            lo &= MASK48
        low[:m] = lo
        size[:m] = step * width.astype(U64)
        for _ in range(2):
            k = np.flatnonzero(size < U64(1 << 32))
            if not len(k):
                break
            out[k, at[k]] = (low[k] >> U64(32)).astype(np.int32)
            at[k] += 1
            low[k] = (low[k] << U64(16)) & MASK48
            size[k] <<= U64(16)
        model.update(m, x, slot, p2, p1, kind)
    if n:
        for shift in (32, 16, 0):
            out[every, at] = ((low >> U64(shift)) & U64(0xFFFF)).astype(np.int32)
            at += 1
        for k in range(out.shape[1] - 1, 0, -1):
            carry = out[:, k] >> 16
            if carry.any():
                out[:, k - 1] += carry
                out[:, k] &= 0xFFFF
    words = out.astype(np.uint16)[np.arange(out.shape[1]) < at[:, None]] if n else np.zeros(0, np.uint16)
    payload = zlib.compress(doc_lengths.astype("<u4").tobytes(), 1)
    payload = struct.pack("<I", len(payload)) + payload + at.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    head = _HEAD.pack(MAGIC, n, lanes, vocab, len(doc_lengths), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload), len(payload))
    return head + payload


def decode_block(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, doc_lengths); raises ValueError on any damage."""
    if len(blob) < _HEAD.size:
        raise ValueError("block is cut off")
    magic, n, lanes, vocab, docs, crc, pcrc, plen = _HEAD.unpack_from(blob)
    payload = blob[_HEAD.size :]
    if magic != MAGIC or len(payload) != plen or zlib.crc32(payload) != pcrc:
        raise ValueError("block is damaged")
    (z,) = struct.unpack_from("<I", payload)
    lengths = np.frombuffer(zlib.decompress(payload[4 : 4 + z]), "<u4").astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32), lengths
    lanes, rows, full = _lanes(n, lanes)
    count = np.frombuffer(payload, "<u4", lanes, 4 + z).astype(np.int64)
    words = np.frombuffer(payload, "<u2", -1, 4 + z + 4 * lanes).astype(np.uint64)
    words = np.concatenate([words, np.zeros(4, np.uint64)])
    at = np.cumsum(count) - count
    code = (words[at] << U64(32)) | (words[at + 1] << U64(16)) | words[at + 2]
    at = at + 3
    size = np.full(lanes, MASK48, U64)
    table = np.zeros((rows, lanes), np.int64)
    model = _Model(vocab, lanes)
    for r in range(rows):
        m = lanes if r < rows - 1 else full
        slot, p2, p1, kind, w2, w1 = model.predict(m)
        w0 = (1 << TOP) - w2 - w1
        base = w2 + w1
        step = size[:m] >> U64(TOP)
        v = np.minimum((code[:m] // step).astype(np.int64), (1 << TOP) - 1)
        rest = np.maximum(v - base, 0)
        x0 = model.symbol(np.minimum((((rest + 1) << TOP) - 1) // w0, (1 << TOP) - 1))
        c, d = (model.cum[x0] * w0) >> TOP, (model.cum[x0 + 1] * w0) >> TOP
        is2, is1 = v < w2, (v >= w2) & (v < base)
        x = np.where(is2, p2, np.where(is1, p1, x0)).astype(np.int64)
        a = np.where(is2, 0, np.where(is1, w2, base + c))
        width = np.where(is2, w2, np.where(is1, w1, d - c))
        code[:m] -= step * a.astype(U64)
        size[:m] = step * width.astype(U64)
        for _ in range(2):
            k = np.flatnonzero(size < U64(1 << 32))
            if not len(k):
                break
            code[k] = ((code[k] << U64(16)) | words[np.minimum(at[k], len(words) - 1)]) & MASK48
            size[k] <<= U64(16)
            at[k] += 1
        table[r, :m] = x
        model.update(m, x, slot, p2, p1, kind)
    ids = np.empty(n, np.uint32)
    cut = full * rows
    ids[:cut] = table[:, :full].T.reshape(-1)
    if rows > 1:
        ids[cut:] = table[: rows - 1, full:].T.reshape(-1)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return ids, lengths

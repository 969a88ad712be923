"""Token counts by a finite-state transducer compiled from a byte-level BPE with word ends.

A word is read byte by byte, its last byte flagged.  For each prefix of a word the last token of the prefix's BPE
is unique, and a token may follow another exactly if BPE keeps the two apart.  So the future depends only on the
longest suffix that begins some token and on the last tokens at the places inside it where a token may begin: a
finite state.  A transition is annotated with the change of the token count; states are made when first reached.

A text is a sequence of symbols cut into chunks of equal length that ignore word boundaries.  After the first word
end in a chunk its state map is constant, so a chunk's map is (head up to there, count and state after it); maps
compose left to right in a prefix scan: chunks with a word end give their end state at once, the others follow.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import util

_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: Stands for a special token in a text; a lone surrogate, which no UTF-8 text can hold.
_MARK = "\ud800"
_CLASSES: list[np.ndarray] = []
CHUNK_SYMBOLS = 2048
#: States that a transducer holds, and cells (4 bytes) of its table of states by symbols.
MOST_STATES = 250_000
MOST_CELLS = 1 << 25


def classes() -> np.ndarray:
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(p, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, kind)
        out[_WHITE] = SPACE
        out[ord(_MARK)] = SPECIAL
        _CLASSES.append(out)
    return _CLASSES[0]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Full(Exception):
    """The states are as many as a worker may hold."""


class Transducer:
    """States of the word machine, compiled when reached.  Symbols: byte, byte + 256 for a word's last, 512 special."""

    def __init__(self, path: str) -> None:
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("not a byte-level BPE with word ends")
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        chars = byte_chars()
        of = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.ends = [vocab[c] for c in chars] + [vocab[c + "</w>"] for c in chars]
        self.rank, spell = {}, {}
        for s, i in enumerate(self.ends):
            spell[i] = (s,)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
            spell[vocab[a + b]] = spell[vocab[a]] + spell[vocab[b]]
        self.spell, self.token = spell, {s: i for i, s in spell.items()}
        self.begins = {s[:k] for s in spell.values() for k in range(1, len(s))}  # proper prefixes of tokens
        self.longest = max(map(len, spell.values()))
        if self.longest >= 64:  # a change of the count is less than the bytes of a token
            raise ValueError("tokens are too long for the packed transitions")
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.column = np.full(513, -1, np.int32)
        self.n_columns = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.keys: dict = {((), ((0, -1, 0),)): 0}
        self.states = [((), ((0, -1, 0),))]

    def bpe(self, symbols: tuple[int, ...]) -> list[int]:
        out = [self.ends[s] for s in symbols]
        while len(out) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
            if best is None:
                break
            (_, new), k = best
            out[k : k + 2] = [new]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            if b not in self.whole:
                self.whole[b] = self.bpe(self.spell[b]) == [b]
            return self.whole[b]
        if (a, b) not in self.apart:
            self.apart[a, b] = self.bpe(self.spell[a] + self.spell[b]) == [a, b]
        return self.apart[a, b]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count)."""
        if symbol == 512:
            return 0, 1
        tail, places = self.states[state]  # places: (how far back, last token there, count there less the count here)
        grown = tail + (symbol,)
        for back, last, less in reversed(places):
            t = self.token.get(grown[len(grown) - back - 1 :])
            if t is not None and self.may_follow(last, t):
                break
        else:
            raise ValueError("no token ends here")
        delta = less + 1
        if symbol >= 256:
            return 0, delta
        keep = [(b + 1, la, le - delta) for b, la, le in places if grown[len(grown) - b - 1 :] in self.begins]
        keep.insert(0, (0, t, 0))
        new = (grown[len(grown) - max(b for b, _, _ in keep) :], tuple(keep))
        if new not in self.keys:
            self.keys[new] = len(self.states)
            self.states.append(new)
        return self.keys[new], delta

    def compile(self, state: np.ndarray, symbol: np.ndarray) -> None:
        """Add the transitions that are missing."""
        for s, y in {*zip(state.tolist(), symbol.tolist())}:
            if self.column[y] < 0:
                if self.n_columns >= self.table.shape[1] and 2 * self.table.size > MOST_CELLS:
                    raise _Full
                self.column[y] = self.n_columns
                self.n_columns += 1
                if self.n_columns > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], 1)
            to, delta = self.move(s, y)
            if len(self.states) > MOST_STATES or len(self.states) > len(self.table) and 2 * self.table.size > MOST_CELLS:
                raise _Full
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[s, self.column[y]] = to << 7 | delta + 64

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = self.column[symbol]
        got = self.table[state, col] if (col >= 0).all() else np.where(col >= 0, self.table[state, col], -1)
        if (got < 0).any():
            miss = got < 0
            self.compile(state[miss], symbol[miss])
            got = self.table[state, self.column[symbol]]
        return got >> 7, (got & 127) - 64

    def run(self, symbols: np.ndarray, size: int = CHUNK_SYMBOLS) -> np.ndarray:
        """The change of the count at each symbol."""
        if len(self.states) > MOST_STATES // 2:
            self.clear()
        n = len(symbols)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        begin = np.arange(0, n, size)
        end = np.minimum(begin + size, n)
        resets = np.flatnonzero(symbols >= 256) + 1
        k = np.searchsorted(resets, begin + (begin > 0))
        sync = np.where(k < len(resets), resets[np.minimum(k, len(resets) - 1)] if len(resets) else n, n)
        sync[0] = 0
        known = sync <= end
        # each chunk's head up to its first reset, or the whole chunk: a map of states, known for the states it was run from
        head = np.minimum(sync, end)
        final = np.full(len(begin), -1, np.int64)
        at = np.flatnonzero(sync <= end)
        final[at] = self.lanes(symbols, out, sync[at], end[at], np.zeros(len(at), np.int64))
        inner = np.flatnonzero(sync > end)  # inside a word: run from a guess, as the state seldom depends on what is far back
        start = np.full(len(begin), -1, np.int64)
        start[0] = start[inner] = 0
        final[inner] = self.lanes(symbols, out, begin[inner], end[inner], start[inner])
        while True:  # the scan: maps compose until each chunk was run from the state that the one before ends in
            todo = np.flatnonzero((begin < head)[1:] & (start[1:] != final[:-1])) + 1
            if not len(todo):
                return out
            start[todo] = final[todo - 1]
            got = self.lanes(symbols, out, begin[todo], head[todo], start[todo])
            whole = sync[todo] > end[todo]
            final[todo[whole]] = got[whole]

    def lanes(self, symbols, out, a, b, state) -> np.ndarray:
        order = np.argsort(a - b, kind="stable")  # longest first
        a, length, state = a[order], (b - a)[order], state[order].copy()
        live = len(a)
        for j in range(int(length[0]) if live else 0):
            while live and length[live - 1] <= j:
                live -= 1
            p = a[:live] + j
            state[:live], d = self.step(state[:live], symbols[p])
            out[p] = d
        back = np.empty_like(state)
        back[order] = state
        return back

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets by text): normalised, cut into words, white space dropped."""
        normal = []
        for t in texts:
            for s in self.specials:
                if s in t:
                    t = t.replace(s, _MARK)
            t = unicodedata.normalize("NFC", t) if not t.isascii() else t
            normal.append((t.replace("Σ", "σ") if "Σ" in t else t).lower())
        whole = "\n".join([*normal, ""])
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in normal])
        kind = classes()[cp]
        # a word begins where the class changes, at each number and special, and around a contraction
        begin = np.ones(len(cp) + 1, bool)
        begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPECIAL)
        quote = np.flatnonzero(cp[:-2] == 39) if len(cp) > 2 else np.zeros(0, int)
        if len(quote):
            quote = quote[begin[quote]]
            one, two = cp[quote + 1], cp[quote + 2]
            n = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
            for x, y in ("re", "ve", "ll"):
                n = np.where((one == ord(x)) & (two == ord(y)), 2, n)
            quote, n = quote[n > 0], n[n > 0]
            begin[quote + 1] = False
            begin[(quote + 2)[n == 2]] = False
            begin[quote + n + 1] = True
        width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        last = np.zeros(len(raw), bool)
        after = np.cumsum(width)
        last[after[begin[1:]] - 1] = True
        keep = np.repeat(kind != SPACE, width)
        out = raw.astype(np.int16)
        out[last] += 256
        special = np.flatnonzero(kind == SPECIAL)
        if len(special):
            out[after[special] - 1] = 512
            keep[after[special] - 2] = keep[after[special] - 3] = False
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        return out[keep], np.concatenate([[0], total[after[ends - 1]]])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens by text; texts that need more states than a worker may hold go on by themselves, at last through the library."""
        symbols, off = self.symbols(texts)
        total = np.zeros(len(symbols) + 1, np.int64)
        try:
            np.cumsum(self.run(symbols), out=total[1:])
        except _Full:
            self.clear()
            if len(texts) > 1:
                half = len(texts) // 2
                return np.concatenate([self.count(texts[:half]), self.count(texts[half:])])
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array([len(self.library.encode(texts[0], add_special_tokens=False).ids)])
        return np.diff(total[off])


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker; what it has compiled serves all its tasks."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are over `limit`.

    Null and empty texts have 0 bytes and 0 tokens; special strings in a text count as one token, as the library has
    it; repeated rows give repeated rows.  Texts are read whole, in Arrow batches, without a shuffle.
    """

    def kernel(batches):
        machine = transducer(path)
        for rb in util.slices(batches, "text", 1 << 20):
            _, off = util.buffers(rb.column("text"))
            n = machine.count(rb.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(off)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    util.ship(docs.sparkSession)
    return util.need(docs, "doc_id", "text").mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

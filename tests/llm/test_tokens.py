import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hitgraph.llm import codec, counting, tokens

from .fixtures import TEXTS, documents

EXTRA = ["it's don't 'tis '' \"'s 12³ x I'LL we've ''s 's's <|endoftext|>A<|startoftext|>b <|endoftext|", "ΑΣ ΣΑΣ İ é é \x1c\x85", "a" * 5000, "".join(map(chr, range(0x300))), "x" * 3000 + " " + "y" * 3000, "аб 😀😀 ½ " * 50, "".join(chr(c) + "a1'" for c in range(256)), "0 1 00 0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_counts_match_the_library(spark, library):
    texts = TEXTS + EXTRA
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in counting.token_counts(documents(spark, texts), tokens.default_tokenizer()).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (want[i] > 2048) for i in got)


def test_chunk_states_compose():
    """Any chunk length gives the same changes: states carry over heads, words longer than chunks included."""
    m = counting.Transducer(tokens.default_tokenizer())
    symbols, _ = m.symbols([t or "" for t in TEXTS + EXTRA])
    want = m.run(symbols, 1 << 40)
    for size in (1, 7, 100):
        assert (m.run(symbols, size) == want).all()


def test_long_unbroken_texts(library, monkeypatch):
    """Chunks inside a word compose; a text that needs more states than allowed is counted all the same."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (9000, 20_000)] + ["ab" * 30_000 + " a", "z" * 50_000, "words " * 10 + "é" * 7000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counting.Transducer(tokens.default_tokenizer()).count(texts).tolist() == want
    monkeypatch.setattr(counting, "MOST_STATES", 500)
    m = counting.Transducer(tokens.default_tokenizer())
    assert m.count(texts).tolist() == want and m.library is not None and len(m.states) <= 502
    monkeypatch.undo()
    monkeypatch.setattr(counting, "MOST_CELLS", 1 << 18)
    m = counting.Transducer(tokens.default_tokenizer())
    assert m.count(texts + TEXTS[3:12]).tolist()[: len(texts)] == want and m.table.size <= 1 << 18


def test_ids_match_the_library(library):
    texts = TEXTS + EXTRA
    coder = tokens.Encoder(tokens.default_tokenizer())
    assert coder.by_words
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for part in (1, 3, 100):
        ids, n = [], []
        for i in range(0, len(texts), part):
            a, b = coder.encode(texts[i : i + part])
            ids.append(a)
            n.extend(b)
        assert n == [len(w) for w in want] and np.concatenate(ids).tolist() == [x for w in want for x in w]


def test_words_that_any_polynomial_hash_confuses(library):
    """A Thue-Morse word and its complement, and words that differ behind their first 8 or 16 bytes."""
    texts = []
    for n in (64, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        texts += [word, word.translate(str.maketrans("ab", "ba")), f"{word} {word}", ""]
    texts += ["abcdefgh abcdefgi abcdefg abcdefghabcdefgh abcdefghabcdefgi abcdefghabcdefghx abcdefghabcdefghy abcdefghabcdefg"]
    coder = tokens.Encoder(tokens.default_tokenizer())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, n = coder.encode(texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    coder = tokens.Encoder(tokens.default_tokenizer())
    for t in TEXTS + EXTRA:
        assert coder.encode([t, t])[0].tolist() == 2 * library.encode(t or "", add_special_tokens=False).ids


def test_codec_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n, vocab, lanes in ((0, 10, None), (1, 10, None), (5, 49408, None), (127, 3, 1), (1000, 49408, 7), (5000, 2, None), (40_000, 300, 64), (9000, 65_536, 9)):
        ids = (rng.zipf(1.3, n) % vocab).astype(np.uint32)
        blob = codec.encode_block(ids, np.array([n]), vocab, lanes)
        got, lengths = codec.decode_block(blob)
        assert (got == ids).all() and lengths.tolist() == [n]
    repeats = np.tile(rng.integers(0, 49_408, 300), 200).astype(np.uint32)
    blob = codec.encode_block(repeats, np.array([len(repeats)]), 49_408, 8)
    assert len(blob) < len(repeats) // 4
    for at in (0, 5, 20, 40, len(blob) // 2, len(blob) - 1):
        with pytest.raises(ValueError):
            codec.decode_block(blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :])
    with pytest.raises(ValueError):
        codec.encode_block(np.array([7], np.uint32), np.array([1]), 7)


def test_files_hold_all_ids_in_order(spark, library, tmp_path):
    texts = TEXTS + EXTRA
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    df = documents(spark, texts).repartition(5)
    path = f"file://{tmp_path}/ids"
    old = tokens.BLOCK_IDS
    tokens.write(df, path, tokens.default_tokenizer())
    got = sorted(tokens.read(spark, path).collect())
    assert tokens.BLOCK_IDS == old and [r.doc_id for r in got] == list(range(len(texts)))
    start = 0
    for r, t in zip(got, texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    d = documents(spark, ["one two", "three"])
    tokens.write(d.unionAll(d), f"file://{tmp_path}/a", tokens.default_tokenizer())
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in tokens.read(spark, f"file://{tmp_path}/a").collect()) == [(0, 0, 3), (0, 3, 3), (1, 6, 2), (1, 8, 2)]
    tokens.write(d.limit(0), f"file://{tmp_path}/b", tokens.default_tokenizer())
    assert tokens.read(spark, f"file://{tmp_path}/b").count() == 0
    assert counting.token_counts(d.limit(0), tokens.default_tokenizer()).count() == 0

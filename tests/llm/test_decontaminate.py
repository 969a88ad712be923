import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hitgraph.llm import decontaminate as dc

from .fixtures import documents


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(texts, items, threshold=0.8):
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, x in items:
            v = words(x)
            if not v:
                continue
            k = min(5, len(v))
            grams = lambda s: Counter(tuple(s[a : a + k]) for a in range(len(s) - k + 1))
            for a in range(len(w) - len(v) + 1):
                s = dc.similarity(grams(w[a : a + len(v)]), grams(v))
                if s >= threshold and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, a)
    return out


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 30, 45, 60])))) for i in range(12)] + [(90, None), (91, ""), (92, "a b")]
    texts = [None, "", "!!"]
    for i in range(40):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        piece = (rng.choice(items[:12])[1]).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            piece[rng.randrange(len(piece))] = rng.choice(vocab)
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + [x.upper() if i % 3 else x + "," for x in piece] + body[at:]))
    texts.append(" ".join([items[3][1]] * 400))
    return texts, items


def test_leaks_match_brute_force(spark):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items] + [items[0] + (2.0,)], "item_id long, text string, similarity double")
    want = brute(texts, items)
    for a_pass in (dc.ITEMS_A_PASS, 6):
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in dc.leaks(documents(spark, texts), bench, a_pass=a_pass).collect()}
        assert got == want
    kept = dc.without_leaks(documents(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == documents(spark, texts).columns
    assert dc.leaks(documents(spark, texts).limit(0), bench).count() == 0 and dc.leaks(documents(spark, texts), bench.limit(0)).count() == 0


def test_every_print_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    items = dc.Items(list(range(30)), [" ".join(f"x{rng.integers(500)}" for _ in range(20)) for _ in range(30)])
    prints = []
    for i in range(30):
        for flips in (0, 5, 12, 19, 20, 25):
            bits = rng.choice(64, flips, replace=False)
            prints.append(int(items.prints[i]) ^ sum(1 << int(b) for b in bits))
    prints = np.array(prints, np.uint64)
    w, i = items.near(prints, 20)
    apart = np.array([[bin(int(p) ^ int(q)).count("1") for q in items.prints] for p in prints])
    assert set(zip(w.tolist(), i.tolist())) == {(int(a), int(b)) for a, b in np.argwhere(apart <= dc.RADIUS)}
    assert dc.words_of(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate((59, 59, 40, 12, 5, 4))]
    texts = [" ".join(x.split()[a : len(x.split()) - z]) for _, x in items for a, z in ((0, 0), (0, 1), (1, 0), (2, 3), (5, 6), (0, 12))]
    whole = brute(texts, items)
    for d, t in enumerate(texts):
        w = words(t)
        for i, x in items:
            v = words(x)
            k = min(5, len(v))
            grams = lambda s: Counter(tuple(s[a : a + k]) for a in range(len(s) - k + 1))
            if k <= len(w) < len(v) and (s := dc.similarity(grams(w), grams(v))) >= 0.8:
                whole[d, i] = (s, 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in dc.leaks(documents(spark, texts), bench).collect()}
    assert got == whole and (1, 0) in got and got[1, 0] == (54 / 55, 0)
    assert {r.doc_id for r in dc.without_leaks(documents(spark, texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in whole}


def test_items_of_many_lengths():
    """Four tables serve all lengths: memory follows the items' number, and each length finds its own items only."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(f"x{v}" for v in rng.integers(0, 5000, n)) for n in range(1, 1001)]
    tracemalloc.start()
    items = dc.Items(list(range(1000)), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(t.nbytes for t in items.tables) == 4 * 4 * 1000 * 2517 and peak < 150 << 20
    for n in (1, 4, 5, 77, 1000):
        own = items.prints[[n - 1]]
        w, i = items.near(np.concatenate([own, own ^ np.uint64(0b1011)]), n)
        assert w.tolist() == [0, 1] and i.tolist() == [n - 1, n - 1]
    assert [len(x) for x in items.near(np.zeros(0, np.uint64), 77)] == [0, 0]
    assert [len(x) for x in items.near(items.prints[:3], 5000)] == [0, 0]


def test_pairs_are_compared_piece_by_piece(monkeypatch):
    """Many copies of one item, as many pairs as windows times copies: pieces of them give the same pairs."""
    items = dc.Items(list(range(60)), ["a b c d e f g h"] * 40 + [f"p{i} q r s t u v w" for i in range(20)])
    prints = np.concatenate([items.prints, items.prints ^ np.uint64(0xFF)])
    whole = items.near(prints, 8)
    assert len(whole[0]) >= 2 * 40 * 40
    monkeypatch.setattr(dc, "PAIRS", 100)
    parts = items.near(prints, 8)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))

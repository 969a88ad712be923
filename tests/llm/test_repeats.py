import hashlib
import random

from hitgraph.llm import repeats

from .fixtures import TEXTS, documents


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            n[b[i : i + length]] = n.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def same(spark, texts, length, gram):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(documents(spark, texts), length, gram).collect()}
    want = brute(texts, length)
    assert len(got) == len(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_awkward_texts(spark):
    same(spark, TEXTS, 20, 8)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(10, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("ab c") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    for length, gram in ((24, 8), (40, 30)):
        same(spark, texts, length, gram)


def test_whole_small_table(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    same(spark, texts, repeats.LENGTH, repeats.GRAM)


def test_repeated_rows_and_empty_table(spark):
    d = documents(spark, ["x" * 50, "ab" * 30, None])
    twice = repeats.remove_repeats(d.unionAll(d), 30, 10).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(0, 50), (0, 50), (1, 60), (1, 60), (2, 0), (2, 0)]
    assert repeats.remove_repeats(d.limit(0)).count() == 0


def test_common_phrase_in_unlike_texts(spark):
    """One q-gram in many surroundings: a task sends two marks of it, whatever their number, and no repeat is lost."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase = word(60)
    texts = [word(rng.randint(30, 90)) + phrase + word(rng.randint(30, 90)) for _ in range(400)]
    texts += [texts[3][20:140] + word(30), word(9) + texts[5], texts[7], texts[7]]
    same(spark, texts, 80, 20)
    d = documents(spark, texts).repartition(3)
    sent = repeats._sample(d.selectExpr("doc_id AS row", "text"), 80, 20)
    assert sent.groupBy("key").count().agg({"count": "max"}).first()[0] <= 2 * 3

import random
import re

from hitgraph.llm import components, jaccard

from .fixtures import TEXTS, documents


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def same(spark, texts, size=3, percent=90, crowded=4):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(documents(spark, texts), size, percent, crowded).collect()}
    want = brute(texts, size, percent)
    assert [(i, got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]] == []


def test_awkward_texts(spark):
    same(spark, TEXTS + ["ONE", "two words", "Two Words"])


def test_near_copies_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    same(spark, texts)
    same(spark, texts, 2, 60)
    same(spark, texts, 2, 60, crowded=0)


def test_whole_small_table(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    same(spark, texts)
    same(spark, texts, 5, 80)


def test_repeated_rows_null_ids_and_empty_table(spark):
    d = documents(spark, ["a b c d", "a b c d", "x y z"])
    null = spark.createDataFrame([(None, "a b c d", "en", "s", 7, 0.5, 1)], d.schema)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in jaccard.similar_components(d.unionAll(d).unionAll(null)).collect())
    assert got == [(-1, None), (0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert jaccard.similar_components(d.limit(0)).count() == 0
    kept = jaccard.one_of_each(d.unionAll(d))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_components_of_a_path_and_a_star(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and len(got) == n + 49


def test_pairs_are_made_once_at_their_first_shared_shingle(spark):
    """Groups of nearly equal prefixes in different components: without links to join them every list holds each pair."""
    rows = []
    for g in range(6):
        shared = [1000 + k for k in range(30)]
        own = [g] if g % 2 else []  # an own shingle first, which no other group has
        for pos, key in enumerate([*own, *shared]):
            rows.append((g, 200, key, pos, True))
    entries = spark.createDataFrame(rows, "gid long, n int, key long, pos int, indexed boolean")
    groups = spark.createDataFrame([(g, 500 + g, 700 + g, bytes(jaccard.SMALL)) for g in range(6)], "gid long, cls long, rep long, small binary")
    labels = spark.createDataFrame([], "node long, component long")
    met = entries.groupBy("key").count().where("count > 1").select("key")
    entries = entries.join(met, "key", "left_semi")
    made = []
    apart = jaccard._pairs_apart
    jaccard._pairs_apart = lambda e, percent, most: made.append(apart(e, percent, most)) or made[-1]
    try:
        pairs, _ = jaccard._still_apart(entries, jaccard._earliest(entries), groups, labels, 80, None)
    finally:
        jaccard._pairs_apart = apart
    assert pairs.count() == 15
    assert made[0].count() == 15  # and not 15 for each of 30 lists


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(2, text, 1, 2, "s"), (1, text, 1, 2, "s"), (3, "other words", 1, 2, "s")], "doc_id long, text string, _text_hash int, _stays int, source string")
    assert sorted(tuple(r) for r in jaccard.one_of_each(df).select("doc_id", "_text_hash", "_stays").collect()) == [(1, 1, 2), (3, 1, 2)]
    from hitgraph.llm import mixing

    clash = df.withColumnsRenamed({"_text_hash": "_mix_at", "_stays": "_mix_id"})
    assert sorted(tuple(r) for r in mixing.in_order(clash).select("doc_id", "_mix_at", "_mix_id").collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]

import re

import numpy as np
import pytest

from hitgraph.llm import boosting, licences, quality

from .fixtures import TEXTS, documents


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_licence(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    at = [(i, v) for i in range(len(w)) for k, v in licences.BASE.items() if w[i : i + len(k.split())] == k.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at}))


def test_licences_match_brute_force(spark):
    got = {r.doc_id: r for r in licences.scan(documents(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[7].labels == "apache,apache-2.0,mit" and got[6].score == 1.0


def test_licence_automata():
    auto = licences.compile_templates({"x": "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;least=1;most=2>> e"})
    for text, ok in (("a d z e", 1), ("a b d z z e", 1), ("a b c d z e", 1), ("a c d z e", 0), ("a d e", 0), ("a d z z z e", 0)):
        w = licences.words(text)
        assert bool(auto.run(w[0], iter(w[1:]))) == bool(ok), text
    with pytest.raises(ValueError):
        licences.compile_templates({"x": "<<var;least=1;most=2>> a"})


def test_empty_tables(spark):
    none = documents(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licences.scan(none).count() == 0
    assert quality.rules(none, labels).count() == 0


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts_match_brute_force(spark):
    labels = spark.createDataFrame([(3, 0, 0), (13, 1, 0), (13, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rules(documents(spark), labels).collect()}
    for i, t in enumerate(TEXTS):
        r, b = got[i], brute_quality(t)
        assert tuple(r[c] for c in quality.COUNTS) == b, i
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.base_failed and r.kept)
    kept = quality.keep_good(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * rng.random(3000) < 0.6).astype(float)
    f = boosting.fit(x, y, np.array([-1, 0, 1]))
    assert ((f.score(x) > 0) == (y > 0.5)).mean() > 0.85
    for j, sign in ((0, -1), (2, 1)):
        z = np.repeat(x[:200], 20, 0)
        z[:, j] = np.tile(np.linspace(0, 1, 20), 200)
        assert (np.diff(f.score(z).reshape(200, 20), axis=1) * sign >= -1e-9).all()


def test_quality_on_labelled_rows(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = quality.rules(d, lab).join(lab, "doc_id").toPandas()
    good = p[(p.quality == 1) & ~p.base_failed]
    assert good.kept.mean() > 0.97

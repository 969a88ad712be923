import random
import re

import pytest

from hitgraph.llm import licences

from .fixtures import documents


def instance(template, rng, keep):
    """(words, which of them are mandatory) of a text that the template allows; keep: whether optional parts are there."""
    out, depth = [], 0
    for part in re.split(r"(<<.*?>>)", template):
        if part.startswith("<<begin"):
            depth += 1
        elif part.startswith("<<end"):
            depth -= 1
        elif depth and not keep:
            continue
        elif part.startswith("<<var"):
            has = dict(x.split("=") for x in part[2:-2].split(";")[1:])
            out += [(f"name{rng.randrange(9)}", False) for _ in range(rng.randint(int(has["least"]), int(has["most"])))]
        else:
            out += [(w, not depth) for w in re.findall(r"\w+", part)]
    return out


def labels(spark, texts):
    return {r.doc_id: set((r.labels or "").split(",")) for r in licences.scan(documents(spark, texts)).collect()}


@pytest.mark.parametrize("label", ["mit", "bsd-2-clause", "bsd-3-clause", "isc-full", "gpl-full-notice", "lgpl-full-notice", "agpl-full-notice", "mpl-2.0-header", "zlib", "unlicense", "boost-1.0", "apache-2.0-header", "cc-by-deed"])
def test_wording(spark, label):
    """Names and optional parts may differ; one changed or missing mandatory word is refused."""
    rng = random.Random(label)
    template = licences.TEMPLATES[label]
    good = [instance(template, rng, keep) for keep in (True, False) for _ in range(3)]
    texts = ["Copyright someone. " + " ".join(w for w, _ in g) + " and more" for g in good]
    bad = []
    for g in good[:2]:
        must = [i for i, (_, m) in enumerate(g) if m]
        for i in {must[0], must[-1], *rng.sample(must, min(12, len(must)))}:
            w = [x for x, _ in g]
            bad.append(" ".join([*w[:i], "changed", *w[i + 1 :]]))
            if label not in ("cc-by-deed", "mpl-2.0-header"):
                bad.append(" ".join([*w[:i], *w[i + 1 :]]))
    found = labels(spark, texts + bad)
    assert all(label in found[i] for i in range(len(texts)))
    # next to a replaceable region a word may be taken for a part of it; elsewhere none is let through
    loose = [i for i in range(len(texts), len(texts) + len(bad)) if label in found[i]]
    assert not loose, [(texts + bad)[i] for i in loose[:2]]

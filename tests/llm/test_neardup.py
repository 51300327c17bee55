import random
import re

import numpy as np
import pytest

from rowtide.llm import neardup
from rowtide.llm.common import components


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return sorted((str(d), len(s), str(best.get(root(i), None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 8, 12, 40, 120, 300]))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "\n \t"), (903, "A b"), (904, "a B"), (905, "a"), (None, texts[0]), (None, "only null"), (7, texts[7]), (906, "É x y z"), (907, "é x y z")]


@pytest.mark.parametrize("seed,size,percent,block", [(1, 3, 85, 400), (2, 5, 80, 3), (3, 1, 80, 400)])
def test_groups_are_exact(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, c int").repartition(4)
    got = neardup.groups(docs, size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one(docs, size, percent)
    assert kept.columns == docs.columns
    want = {r[2] for r in brute(rows, size, percent) if r[1]}
    words = [r for r in kept.collect() if (r.text or "").split()]
    assert len(words) == len(want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.groups(none).collect() == [] and neardup.keep_one(none).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, k) for k in range(4000, 4200)] + [(1, 1)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: root(x) for a, b in links if a != b for x in (a, b)} and len(got) == len({r.id for r in got})


def test_estimates_of_many_are_those_of_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(900, rng.integers(1, 800)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(30)]
    low, n = [s[: neardup.SKETCH] for s in sets], np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(low)), [len(x) for x in low])
    place = np.concatenate([np.arange(len(x)) for x in low])
    values = np.concatenate(low)
    order = np.argsort(values, kind="stable")
    for k, s in enumerate(low):
        est, whole = neardup.estimates(s, int(n[k]), values[order], place[order], owner[order], n)
        want = [neardup.estimate(s, x, int(n[k]), int(m)) for x, m in zip(low, n)]
        assert np.allclose(est, [e for e, _ in want]) and whole.tolist() == [w for _, w in want]

import hashlib
import random

import numpy as np
import pytest

from rowtide.llm import fingerprints as fp
from rowtide.llm import suffixes


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(1)
    for size, share in ((3, 1.0), (40, 0.5), (400, 0.8), (3000, 0.3), (5000, 0.0)):
        both = int(round(2 * size * share / (1 + share)))
        values = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
        a, b = values[:size], values[size - both :]
        true = both / len(values)
        assert abs(fp.likeness(fp.codes(a), fp.codes(b)) - true) < 0.08
    assert fp.likeness(fp.codes(values[:0]), fp.codes(values)) == 0 and fp.likeness(fp.codes(values[:0]), fp.codes(values[:0])) == 1


def test_packing_of_codes():
    code = fp.codes(np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (fp.unpacked(fp.packed(code)) == code).all() and len(fp.packed(code)) == 1024


def test_edited_pairs(spark):
    random.seed(5)
    rows = [(k, " ".join(random.choice("abcdefgh") * 3 for _ in range(random.randint(0, 60)))) for k in range(60)] + [(61, None), (None, "null id"), (60, "tie b"), (60, "tie a"), (70, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fp.edited_pairs(docs).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(map(str, [(r.doc_id, r.n_chars, r.edited_sha256) for r in got])) == sorted(map(str, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.edited_pairs(docs.limit(0)).collect() == []
    one = fp.edited_pairs(docs.where("doc_id = 70")).first()
    assert one.edited_sha256 == hashlib.sha256(("é" * 9).encode()).hexdigest() and one.near_next == 1


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (4, " \n", "w")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert got[1] == got[2] != "" and got[3] == got[4] == ""


def brute(texts, depth):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for p in range(len(d) - depth + 1):
            seen.setdefault(d[p : p + depth], []).append((k, p))
    hit = [np.zeros(len(d), bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                hit[k][p : p + depth] = True
    out = []
    for d, h in zip(data, hit):
        spans = int((np.diff(np.r_[0, h.astype(int)]) == 1).sum())
        out.append((len(d), int(h.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~h].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1 << 17), (2, 700), (3, 150)])
def test_repeats_are_exact(spark, seed, block):
    rng = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdefghijklmnopé "
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(12)]
    texts = list(base)
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(texts)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        texts.append(a[:i] + rng.choice(["", "x", "yy"]) + b[j : j + rng.randint(0, 600)] + rng.choice(base)[:200])
    texts += [None, "", "q" * 1500, "q" * 130, "ab" * 500, base[0], base[0], "z" * 119, "z" * 112, "z" * 113]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 0), (None, base[1] + "!", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int").repartition(4)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(docs, 112, block=block).select(*["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).na.fill(-1, ["doc_id"]).collect())
    want = sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], 112)))
    assert got == want
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []

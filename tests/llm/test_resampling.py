import random

import numpy as np

import quern.llm.resampling as m
from quern.llm.common import text_hashes

DOCS = "doc_id long, text string, key string, kept int"


def data(n, seed):
    r = random.Random(seed)
    rows, ids = [], []
    for i in range(n):
        good = r.random() < 0.7
        w = [r.choice(["alpha", "beta", "gamma"]) + str(r.randrange(50)) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(w if good else [x + "$$" for x in w]), "k", 1))
        ids.append((i, good))
    return rows, ids


def test_weights_and_cut(spark):
    rows, ids = data(400, 1)
    rows += [(500, None, "", 0), (501, "", "", 0), (502, " \n", "", 0), (None, rows[0][1], "", 0), (7, rows[7][1], "", 0), (503, "alpha1 " * 50000, "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    target = spark.createDataFrame([(i,) for i, g in ids[:200] if g] + [(None,), (3,), (99999,)], "doc_id long")
    got = m.resample(docs, target).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == int(m.SHARE * (len(rows) - 3))
    named = {i for i, g in ids[:200] if g} | {3}
    n = np.ones((2, m.BUCKETS))
    for i, t, *_ in rows:
        for b in m.buckets_of(text_hashes((t or "").encode())):
            n[0, b] += 1
            n[1, b] += i in named
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    by = {(r.doc_id, r.n_grams): r for r in got}
    keys = []
    for i, t, *_ in rows:
        h = text_hashes((t or "").encode())
        w = ratio[m.buckets_of(h)].sum()
        r = by[i, len(m.buckets_of(h))]
        assert abs(r.log_weight - w) < 1e-6
        if len(h):
            keys.append(w + m.gumbel(i, h))
    k = int(m.SHARE * len(keys))
    low = sorted(keys, reverse=True)[k - 1]
    assert all(r.kept == (r.n_grams > 0 and r.key >= low - 1e-9) for r in got if abs(r.key - low) > 1e-6)
    bad = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400 and not ids[r.doc_id][1]]
    fine = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400 and ids[r.doc_id][1]]
    assert np.mean([r.kept for r in fine]) > 0.95 and np.mean([r.kept for r in bad]) < 0.6
    again = m.resample(docs.repartition(2), target).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_ties_and_empty(spark):
    rows = [(1, "same words here", "", 0)] * 10
    got = m.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long"), share=0.5).collect()
    assert sum(r.kept for r in got) == 5
    assert m.resample(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long")).collect() == []


def test_cut(spark):
    v = np.random.default_rng(0).integers(-(2**62), 2**62, 500).tolist() + [5] * 40 + [-3] * 7
    d = spark.createDataFrame([(x,) for x in v], "x long")
    for k in (1, 2, 100, 255, 280, len(v)):
        top = sorted(v, reverse=True)
        assert m.cut(d, "x", k) == (top[k - 1], sum(x > top[k - 1] for x in v))
    assert m.cut(d, "x", 0) is None and m.cut(d, "x", len(v) + 1) is None

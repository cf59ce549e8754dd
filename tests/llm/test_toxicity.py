import random

import numpy as np

import quern.llm.toxicity as m

DOCS = "doc_id long, text string, toxic string, fold int"
LABELS = "doc_id long, quality int, toxic int, text string"
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ren", "dol", "sut") for c in ("a", "o", "ion", "ent")]
BAD = ["vileness", "grubbish", "oafwort"]


def data(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = r.choices(VOCAB, k=r.randint(10, 120))
        toxic, low = r.random() < 0.25, r.random() < 0.2
        if toxic:
            w[r.randrange(len(w))] = r.choice(BAD).title() + r.choice(["", ",", "."])
        if low:
            w = [x + r.choice(["", "zzz"]) for x in w]
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, int(not low), int(toxic), "t"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = data(600, 1)
    chain = m.train(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1, ""), (3, None, None, "")], LABELS), m.CATEGORIES)
    assert chain.auc["toxic"] > 0.97 and len(chain.models[1].weights) == len(chain.models[1].chosen) + 2
    test, truth = data(300, 2)
    extra = [(1000, None, None, None), (1001, "", None, None), (1002, " \n", None, None), (None, "vileness grubbish oafwort", None, None), (1003, "karena " * 40000 + "vileness oafwort", "", 0)]
    frame = spark.createDataFrame(test + extra, DOCS)
    got = {r.doc_id: r for r in m.classify(frame, chain).collect()}
    hit = np.array([got[i].is_toxic for i, *_ in test])
    want = np.array([t == 1 for _, _, t, _ in truth])
    assert (hit & want).sum() >= 0.95 * want.sum() and (hit & ~want).sum() <= 2
    assert not any(got[i].is_toxic or got[i].p_toxic for i in (1000, 1001, 1002)) and got[None].is_toxic and got[1003].is_toxic
    kept = m.remove(frame, chain, "toxic")
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.is_toxic}


def test_fit_is_the_optimum():
    r = np.random.default_rng(0)
    x = r.random((200, 3))
    y = (x[:, 0] + r.normal(0, 0.3, 200) > 0.5).astype(float)
    w = m.fit(x, y)
    loss = lambda v: -(y * np.log(q := m.sigmoid(x @ v[:3] + v[3])) + (1 - y) * np.log(1 - q)).sum() + 0.5 * (m.DECAY * v[:3] @ v[:3] + 1e-6 * v[3] ** 2)
    assert all(loss(w) <= loss(w + r.normal(0, 0.01, 4)) for _ in range(50))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "", 0)], DOCS)
    chain = m.train(docs, spark.createDataFrame([], LABELS), m.CATEGORIES)
    assert [r.is_toxic for r in m.classify(docs, chain).collect()] == [False]
    assert m.classify(spark.createDataFrame([], DOCS), chain).collect() == []

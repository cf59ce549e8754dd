import random
import re
from collections import Counter

import numpy as np

import quern.llm.toxicity as m

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "dol", "s") for c in ("a", "o", "ion")]


def corpus(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = r.choices(WORDS, k=r.randint(3, 20))
        toxic, low = r.random() < 0.4, r.random() < 0.4
        if toxic and r.random() < 0.9:
            w[0] = r.choice(["Vile-ness,", "grubbish", "grubber"])
        if low and r.random() < 0.8:
            w[-1] = r.choice(["zzz", "ZZz9zz"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def plain_features(text):
    out = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        w = "".join(c for c in w if c.isalpha())
        out |= {("whole", w)} | {("begins", w[:k]) for k in range(3, min(len(w), 7) + 1)} if w else set()
    return out


def descend(x, y, decay):
    """Optimum of the decayed logistic loss by plain gradient descent."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, reg = np.zeros(a.shape[1]), np.array([decay] * x.shape[1] + [1e-6])
    rate = 1 / (0.25 * np.linalg.norm(a, 2) ** 2 + decay)
    v, was = w, w
    for k in range(20_000):  # Nesterov's steps
        g = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) + reg * v
        w = v - rate * g
        v, was = w + k / (k + 3) * (w - was), w
    return w


def test_chain_against_plain_computation(spark):
    docs, labels = corpus(160, 5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    chain = m.train(frame.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), m.CATEGORIES)
    fold = {r.i: r.f for r in spark.range(160).selectExpr("id i", f"cast(pmod(xxhash64(id, 13), {m.FOLDS}) as int) f").collect()}
    feats = {i: plain_features(t) for i, t in docs}
    ys = [{i: int(q == 0) for i, q, _ in labels}, {i: t for i, _, t in labels}]
    ids = [i for i, _ in docs]

    def choose(use, y):
        n, pos = Counter(f for i in use for f in feats[i]), Counter(f for i in use if y[i] for f in feats[i])
        total, positives = len(use), sum(y[i] for i in use)
        rest, out = max(total - positives, 1), []
        for f in n:
            p, q = (pos[f] + 0.1) / (positives + 0.2), (n[f] - pos[f] + 0.1) / (rest + 0.2)
            z = abs(p - q) / np.sqrt(max(p * (1 - p), 1e-9) / positives + max(q * (1 - q), 1e-9) / rest)
            if n[f] >= m.LEAST and z > 2.5:
                out.append(f)
        return out

    matrix = lambda use, chosen, before: np.array([[f in feats[i] for f in chosen] + before[i] for i in use], float)
    before, final, thresholds = {i: [] for i in ids}, {i: [] for i in ids}, []
    for y in ys:
        oof = {}
        for out in [*range(m.FOLDS), None]:
            use = [i for i in ids if fold[i] != out]
            chosen = choose(use, y)
            assert len(chosen) <= m.CHOSEN
            w = descend(matrix(use, chosen, before), np.array([y[i] for i in use]), m.DECAY)
            test = ids if out is None else [i for i in ids if fold[i] == out]
            x = matrix(test, chosen, final if out is None else before)
            p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            if out is None:
                last = dict(zip(test, p, strict=True))
            else:
                oof |= dict(zip(test, p, strict=True))
        fewest = min((sum(oof[i] < t and y[i] for i in ids) + wrong, wrong) for t in [*sorted(set(oof.values())), 2] if (wrong := sum(oof[i] >= t and not y[i] for i in ids)) <= m.FALSE_RATE * sum(not y[i] for i in ids))
        thresholds.append((oof, y, fewest[0]))
        for i in ids:
            before[i] = before[i] + [oof[i]]
            final[i] = final[i] + [last[i]]
    got = {r.doc_id: r for r in m.classify(frame, chain).collect()}
    for i in ids:
        assert abs(got[i].p_low_quality - final[i][0]) < 2e-3 and abs(got[i].p_toxic - final[i][1]) < 2e-3
    for t, (oof, y, fewest) in zip(chain.thresholds, thresholds, strict=True):
        assert sum((oof[i] >= t) != bool(y[i]) for i in ids) == fewest


def test_repeated_rows_ties_and_clashing_columns(spark):
    docs, labels = corpus(160, 6)
    frame = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in docs + docs[:40]], "doc_id long, text string, fold string, f int, p_toxic double")
    chain = m.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), m.CATEGORIES)
    got = m.classify(frame, chain).collect()
    assert len(got) == 200 and len({(r.doc_id, r.p_toxic, r.is_toxic) for r in got}) == 160
    kept = m.remove(frame, chain, "toxic")
    assert kept.columns == frame.columns
    n = Counter(r.doc_id for r in kept.collect())
    assert all(n[r.doc_id] == (0 if r.is_toxic else 1 + (r.doc_id < 40)) for r in got)


def test_cut():
    y = np.array([1.0, 1, 0, 0, 0])
    assert 0.2 < m.cut(np.array([0.9, 0.8, 0.2, 0.1, 0.1]), y) < 0.8
    assert m.cut(np.array([0.5] * 5), y) > 0.5 and m.cut(np.zeros(3), np.zeros(3)) > 1

import random
import re

import quern.llm.decontaminate as m

DOCS = "doc_id long, text string, item_id long, shared string"
ITEMS = "item_id long, text string, doc_id long"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return w, ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        w, s = shingles(t)
        for i, q, *_ in items:
            v, own = shingles(q)
            if not v:
                continue
            if len(v) < 5:
                both = int(any(w[k : k + len(v)] == v for k in range(len(w) - len(v) + 1)))
            else:
                both = len(own & s)
            if 100 * both >= 80 * len(own):
                out.add((d, i, both, len(own)))
    return out


def data(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(n), 0) for i, n in enumerate([1, 2, 4, 5, 6, 8, 12, 20, 24, 40, 70, 90, 300])]
    items += [(90, None, 0), (91, " \n", 0), (92, "", 0), (3, items[3][1], 0)]
    docs, i = [], 0
    for n in (0, 3, 10, 100, 1000, 9000):
        for _, q, _ in items:
            w = (q or "").split()
            for bad in (0, 1, len(w) // 10, len(w) // 4):
                v = list(w)
                for k in r.sample(range(len(v)), min(bad, len(v))):
                    v[k] = "x"
                docs.append((i, f"{text(n)}\n{' '.join(v).upper()}\t{text(n // 2)}", 1, "a"))
                i += 1
    return docs + [(i, None, 1, None), (i + 1, "", 1, None), (0, docs[0][1], 2, "b")], items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = data(1)
    run = lambda: {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in m.containment(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert run() == want
    monkeypatch.setattr(m, "BLOCK_CHARS", 500)
    assert run() == want


def test_removal_and_empty_tables(spark):
    docs, items = data(2)
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = m.remove_contaminated(d, q)
    bad = {x[0] for x in brute(docs, items)}
    assert got.columns == d.columns and sorted(r[0] for r in got.collect()) == sorted(x[0] for x in docs if x[0] not in bad)
    none = spark.createDataFrame([], ITEMS)
    assert m.containment(d, none).collect() == [] and m.remove_contaminated(d, none).count() == len(docs)
    assert m.containment(spark.createDataFrame([], DOCS), q).collect() == []

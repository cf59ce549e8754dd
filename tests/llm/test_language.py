import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import quern.llm.language as m

SCHEMA = "doc_id long, text string, lang string, score double"
PARTS = {"aa": ["the", "ing", "tion", "er", "ou"], "bb": ["ich", "sch", "ung", "ä", "ge"], "cc": ["при", "вет", "ость", "ны"]}


def text(r, lang, n):
    return " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 4))) for _ in range(n))


def data(seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(200):
        lang = r.choice(list(PARTS))
        rows.append((i, text(r, lang, r.randint(3, 80)), lang, 1.0))
    return rows


def test_paths_against_all_paths():
    r = np.random.default_rng(1)
    docs = [-(r.random((n, 3)) * 20).astype(np.float32) for n in (5, 0, 1, 6, 5)]
    for s, p in zip(docs, m.paths(docs), strict=True):
        cost = lambda q: sum(float(s[t, k]) for t, k in enumerate(q)) - m.SWITCH * sum(a != b for a, b in zip(q[:-1], q[1:], strict=True))  # noqa: E731, B023
        if len(s):
            assert abs(cost(tuple(p)) - max(cost(q) for q in itertools.product(range(3), repeat=len(s)))) < 1e-4
        else:
            assert len(p) == 0


def test_held_out_and_spans(spark):
    rows = data()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = m.model_of(docs)
    r = random.Random(9)
    mixed = text(r, "aa", 40) + "\n" + text(r, "bb", 25) + " 123 --- " + text(r, "aa", 3)
    extra = [(1000, mixed, None, None), (1001, None, "aa", None), (1002, "", "aa", None), (1003, "12 % --\n", "aa", None), (1004, "ωω ωω", None, None), (None, text(r, "cc", 9), "cc", 1.0), (1005, text(r, "bb", 30000), None, 0.0)]
    got = {x.doc_id: x for x in m.identify(spark.createDataFrame(rows + extra, SCHEMA), model).collect()}
    held = [x[0] for x in docs.where(m.remainder("doc_id") == 2).select("doc_id").collect()]
    truth = {i: la for i, _, la, _ in rows}
    assert len(held) > 20 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert got[1000].lang_pred == "aa" and 0.4 < got[1000].score < 1 and len(got[1000].spans) >= 2
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001].score == 0
    assert got[None].lang_pred == "cc" and got[1005].lang_pred == "bb" and got[1005].spans[0].words == 30000
    kept = m.keep_identified(spark.createDataFrame(rows + extra, SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {1001, 1002, 1003}.isdisjoint({x.doc_id for x in kept.collect()}) and kept.count() >= 200


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = m.model_of(docs)
    assert model.languages == [] and m.identify(docs, model).collect() == []
    one = spark.createDataFrame([(1, "a b", None, None)], SCHEMA)
    assert m.identify(one, model).collect()[0].lang_pred == "und"
    assert one.where(m.remainder("doc_id") == F.lit(1)).count() in (0, 1)

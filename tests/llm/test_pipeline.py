import re
from collections import defaultdict

import corpus_pipeline
from quern.llm import language, toxicity

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return w, ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


def test_stages_against_brute_force(spark):
    """Each stage's decisions against a plain computation on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        nxt = stage(spark, docs, SF)
        assert nxt.columns == cols and nxt.dtypes == docs.dtypes
        after = {r.doc_id: r for r in nxt.collect()}
        assert all(after[i] == before[i] for i in after)
        if name == "language_id":
            got = {r.doc_id: r for r in language.identify(docs, language.model_of(docs)).collect()}
            assert set(after) == {i for i, r in got.items() if r.lang_pred != "und" and r.score >= language.KEEP_SHARE}
        elif name == "toxicity":
            got = toxicity.classify(docs, toxicity.chain_of(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert set(after) == {r.doc_id for r in got if not r.is_toxic}
        elif name == "ngram_join":
            s = {i: shingles(r.text)[1] for i, r in before.items()}
            root = {i: i for i in s}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a in s:
                for b in s:
                    if a < b and s[a] and s[b] and 100 * (both := len(s[a] & s[b])) >= 80 * (len(s[a]) + len(s[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
            assert set(after) == {i for i in s if find(i) == i}
        else:
            items = [shingles(r.text)[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, r in before.items() if any(100 * len(q & shingles(r.text)[1]) >= 80 * len(q) for q in items)}
            assert set(after) == set(before) - bad
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in mixed:
        size[r.source] += len(shingles(after[r.doc_id].text)[0])
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert len(mixed) == len(after) and all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_clashing_columns_nulls_and_repeats(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "y"), (2, "the same words again and again here", "en", "a", 1, "z"), (3, "the same words again and again here", "en", None, 1, "z"), (3, "the same words again and again here", "en", None, 1, "z"), (4, "12 34 --", "en", "b", 1, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, shingles string",
    )
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert [r.doc_id for r in docs.collect()] == [2]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []

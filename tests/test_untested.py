"""Queries without SQL against plain computations on the same tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.operators import dedup as dd
from quern.operators import graph as gr
from quern.operators import scoring as sc
from quern.operators import validate as va

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def shingles(t, k=3):
    w = words(t)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def group(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.fixture(scope="module")
def similar(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {i: s for i, t in texts.items() if (s := shingles(t))}
    every = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    return texts, sets, {p: j for p, j in every.items() if j >= 0.5}


def test_similar_pairs_and_what_follows(spark, similar):
    texts, sets, want = similar
    got = {(r.a, r.b): r.similarity for r in plans.QUERIES["D5_similar_pairs"](spark, SF).collect()}
    assert all((min(p), max(p)) in want and want[min(p), max(p)] == pytest.approx(s) for p, s in got.items())
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = {p for p in want if first[frozenset(sets[p[0]])] == p[0] and first[frozenset(sets[p[1]])] == p[1]}
    found = sum(p in got or p[::-1] in got for p in reps)
    assert found >= 0.99 * len(reps) and len(want) > 20
    # at half as similar, two rows of 32 bands: a pair is missed with a probability of 0.75 to the power of 32
    labels = {r.id: r.cluster for r in plans.QUERIES["D7_clusters"](spark, SF).collect()}
    assert labels == group(got) and sum(labels.get(a) == labels.get(b) for a, b in want) >= 0.99 * len(want)
    members = defaultdict(list)
    for i, t in texts.items():
        members[labels.get(i, ("own", i))].append((-len(t), i))
    kept = {r.id for r in plans.QUERIES["D9_deduplicate"](spark, SF).collect()}
    assert kept == {min(m)[1] for m in members.values()}
    ratio = plans.QUERIES["D8_duplicate_ratio"](spark, SF).first().ratio
    assert ratio == pytest.approx((len(texts) - len(members)) / len(texts))


def test_clusters_do_not_end_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.cluster for r in dd.clusters(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        dd.clusters(chain, rounds=1)


def test_title_matches(spark):
    r = random.Random(3)
    vocab = ["the", "of"] * 6 + [f"t{i}" for i in range(40)]
    left = [(i, " ".join(r.choices(vocab, k=r.randint(1, 9)))) for i in range(60)] + [(99, "")]
    right = [(100 + i, t + r.choice(["", "", " extra", " t1"])) for i, t in left] + [(300, "The OF"), (299, "of the")]
    for threshold in (0.9, 0.5, 0.2):
        want = {}
        for i, a in left:
            for j, b in sorted(right):
                x, y = set(words(a)), set(words(b))
                if x and y and len(x & y) / len(x | y) >= threshold and i not in want:
                    want[i] = (j, pytest.approx(len(x & y) / len(x | y)))
        got = dd.title_matches(spark.createDataFrame(left, "id int, title string"), spark.createDataFrame(right, "id int, title string"), threshold)
        assert {x.l: (x.r, x.similarity) for x in got.collect()} == want


def test_unknown_claims(spark):
    r = random.Random(4)
    vocab = ["the", "and"] * 8 + [f"word{i}" for i in range(60)]
    claims = [" ".join(r.choices(vocab, k=r.randint(4, 14))) for _ in range(40)]
    said = [(i, ". ".join(" ".join([w for w in r.choice(claims).split() if r.random() < 0.8] + r.choices(vocab, k=r.randint(0, 9))) for _ in range(4)) + ".") for i in range(30)]
    want = Counter()
    for i, t in said:
        for s in filter(None, (x.strip() for x in re.split(r"[.!?]+", t))):
            w = set(words(s))
            if len(s) > 30 and len(w) > 3 and not any(len(w & set(words(c))) > 0.6 * len(w) for c in claims):
                want[i, s] += 1
    got = va.unknown_claims(spark.createDataFrame(said, "id int, text string"), spark.createDataFrame([(c,) for c in claims], "text string"))
    assert Counter((x.id, x.sentence) for x in got.collect()) == want and 0 < sum(want.values()) < 110


def test_calibration_fits(spark):
    r = random.Random(6)
    rows = [(round(r.gauss(0, 2), 1), r.randint(0, 1)) for _ in range(300)]
    a = b = 0.0
    for _ in range(100):
        e = [(1 / (1 + math.exp(-(a * x + b))) - y, x) for x, y in rows]
        a, b = a - 0.01 * sum(g * x for g, x in e) / 300, b - 0.01 * sum(g for g, _ in e) / 300
    t = 1.0
    for _ in range(50):
        t = min(10.0, max(0.1, t - 0.1 * sum((1 / (1 + math.exp(-x / t)) - y) * -x / t**2 for x, y in rows) / 300))
    d = spark.createDataFrame(rows, "logit double, y int")
    assert sc.platt(d) == pytest.approx((a, b)) and sc.temperature(d) == pytest.approx(t)
    assert sc.platt(d.limit(0)) == (0.0, 0.0) and sc.temperature(d.limit(0)) == 1.0


def test_pagerank(spark):
    r = random.Random(7)
    nodes, edges = list(range(30)), [(r.randrange(25), r.randrange(30)) for _ in range(90)]
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    rank = dict.fromkeys(nodes, 1 / 30)
    for _ in range(100):
        lost = sum(rank[i] for i in nodes if not out[i])
        new = {i: 0.15 / 30 + 0.85 * lost / 30 for i in nodes}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        change, rank = sum(abs(new[i] - rank[i]) for i in nodes), new
        if change < 30 * 1e-6:
            break
    got = gr.pagerank(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges + edges[:5], "src long, dst long"))
    assert {x.id: x.rank for x in got.collect()} == pytest.approx(rank, abs=1e-6)


def test_allocation(spark):
    rows = [(i, float(s), p) for i, (s, p) in enumerate([(0, 0), (3, 10), (9, 10), (2, 4), (0, 0), (1, 50)])]
    d = sc.allocate(sc.ucb(spark.createDataFrame(rows, "id int, reward double, pulls int").withColumn("boost", F.lit(1.0))), 100)
    total = sum(p for *_, p in rows)
    score = {i: math.inf if not p else s / p + math.sqrt(2) * math.sqrt(math.log(total) / p) for i, s, p in rows}
    top = max(x for x in score.values() if x < math.inf)
    score = {i: 2 * top if x == math.inf else x for i, x in score.items()}
    assert {x.id: x.budget for x in d.collect()} == {i: max(5, min(math.floor(100 * x / sum(score.values())), 40)) for i, x in score.items()}


def test_entity_matches(spark):
    got = {r.name: (r.entity, r.score) for r in plans.QUERIES["F13_entity_match"](spark, SF).collect()}
    s = {r.s_name: r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    want = {name + (" Inc." if k % 2 == 0 else " LTD"): (k, 1.0) for name, k in s.items()}
    assert got == want


def test_known_names_are_not_compared_with_similar_ones(spark, monkeypatch):
    from quern.functions import identity
    from quern.operators import evidence as ev

    e = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = [("Acme North Inc.",), ("The Acme",)]
    entities, aliases = e([(1, "Acme North"), (2, "Acme South")], "id long, name string"), e([(2, "The Acme")], "entity_id long, alias string")
    near = {(r.name, r.entity) for r in ev.entity_matches(e([*names, ("Acme North South",)], "name string"), entities, aliases, 0.6).collect()}
    assert near == {("Acme North Inc.", 1), ("The Acme", 2), ("Acme North South", 1)}
    monkeypatch.setattr(identity, "name_similarity", lambda a, b: F.raise_error(F.concat(F.lit("compared "), a["canonical"])).cast("double"))
    got = ev.entity_matches(e(names, "name string"), entities, aliases)
    assert {(r.name, r.entity, r.score) for r in got.collect()} == {("Acme North Inc.", 1, 1.0), ("The Acme", 2, 0.95)}

from collections import defaultdict
from fractions import Fraction

import duckdb
import pandas as pd

from quern.llm.mixing import OP4_SQL, mix

SCHEMA = "doc_id long, text string, source string, size long, target string"


def levels(total):
    """Targets by clamping and resharing in exact fractions."""
    names = sorted([s for s in total if s is not None]) + [None] * (None in total)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(total.values()), set(names), {}
    while open_:
        ws = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / ws > 2 * total[s]}
        if not over:
            return out | {s: left * w[s] / ws for s in open_}
        for s in over:
            out[s] = Fraction(2 * total[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


ROWS = [(i, " ".join(["w"] * (1 + i % 40)), f"s{i % 7 if i % 3 else 0}", 1, "x") for i in range(500)]
ROWS += [(1000, None, "s1", 0, None), (1001, "", None, 0, None), (1002, "a b\tc\x0bd", None, 0, None), (None, "q " * 30, "é", 0, None), (None, "q " * 31, "é", 0, None), (1003, "big " * 9000, "zz", 0, None), (5, "w " * 6, "s5", 1, "x"), (5, "w " * 6, "s5", 1, "x")]


def test_mix(spark):
    got = mix(spark.createDataFrame(ROWS, SCHEMA).repartition(7)).toPandas()
    total, taken = defaultdict(int), defaultdict(int)
    for _, t, s, *_ in ROWS:
        total[s] += len((t or "").split())
    want = levels(total)
    assert len(got) == len(ROWS)
    for r in got.itertuples():
        assert 0 <= r.taken <= 2 * r.size
        s = None if pd.isna(r.source) else r.source
        assert abs(r.target - float(want[s])) < 1e-6 and r.source_size == total[s]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mix(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).toPandas()
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got) == key(again)
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text", "source", "size", "target"]).drop(columns=["size", "target"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.sql(OP4_SQL).df()
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    norm = lambda d: sorted(tuple(-1 if pd.isna(x) else float(x) for x in r) for r in d[cols].itertuples(index=False))
    assert norm(sql) == norm(got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mix(spark.createDataFrame([(1, None, None, 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got] == [(1, 0, 0, 0.0, 0)]

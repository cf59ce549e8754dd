import random
from datetime import datetime, timedelta

import duckdb

import quern.llm.url_lists as m

BASE = datetime(2024, 1, 1)


def brute(captures, entries):
    out = []
    for k, url, t, *_ in captures:
        host = url.split("://")[1].split("/")[0].split(":")[0].lower() if url and "://" in url else None
        best = None
        for name in {e[0] for e in entries}:
            for h in {(e[1] or "").lower() for e in entries if e[0] == name}:
                log = [e for e in entries if e[0] == name and (e[1] or "").lower() == h and e[3] is not None and t is not None and e[3] <= t]
                if not log or not host or not (host == h or host.endswith("." + h)):
                    continue
                last = max(e[3] for e in log)
                now = [e for e in log if e[3] == last]
                if any(e[4] == "remove" for e in now):
                    continue
                cand = (-h.count("."), max(e[2] for e in now), name, h, last)
                best = min(best, cand) if best else cand
        out.append((k, best[1] if best else "none", best[2] if best else None, best[3] if best else None, best[4] if best else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "z.b.org", "com"]
    entries = [(r.choice(["spam", "bad", "ok"]), r.choice(hosts).upper(), None, BASE + timedelta(hours=r.randrange(40)), r.choice(["add", "add", "remove"])) for _ in range(60)]
    entries = [(a, h, "allow" if a == "ok" else "block", t, x) for a, h, _, t, x in entries] + [("bad", None, "block", BASE, "add"), ("bad", "b.org", "block", None, "add")]
    caps = [(i, f"http://{r.choice(hosts)}{r.choice(['', ':80', '/p?x'])}", BASE + timedelta(minutes=r.randrange(2600)), "x") for i in range(300)]
    caps += [(1, caps[1][1], caps[1][2], "x"), (400, None, BASE, None), (401, "no host", BASE, None), (402, "http://a.com", None, None), (None, "http://A.com/" + "q" * 90000, BASE + timedelta(days=3), None)]
    c = spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp, list string")
    e = spark.createDataFrame(entries, "list string, host string, verdict string, at timestamp, action string")
    got = m.filter_captures(c, e).select("page_id", "verdict", "list", "entry", "since").collect()
    assert sorted(map(tuple, got), key=str) == brute(caps, entries)
    assert m.filter_captures(c.limit(0), e).collect() == []
    assert {r.verdict for r in m.filter_captures(c, e.limit(0)).collect()} == {"none"}


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    cols = ["page_id", "url", "host", "fetched_at", "verdict", "list", "entry", "since"]
    want = sorted(map(str, con.sql(m.OP3_SQL).select(*cols).fetchall()))
    got = sorted(str(tuple(r)) for r in m.op3(spark, d).select(*cols).collect())
    assert got == want and len({x.split("'")[5] for x in got}) > 1

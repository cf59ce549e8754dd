import base64
import hashlib

import quern.llm.warc as m

SCHEMA = "page_id long, url string, html string, digest int"


def want(rows):
    best = {}
    for i, _, h, *_ in rows:
        best.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        top = max((x for x in best[h or ""] if x is not None), default=None)
        kind = "response" if len(best[h or ""]) == 1 or i == top else "revisit"
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h{i % 3}.example/p/{i}?q=1#f", ("<p>é日本</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * (i % 5)), 1) for i in range(40)]
ROWS += [(100, None, None, None), (101, "", "", 1), (102, "bad url\r\nX: y", "same", 1), (103, "http://x", "same", 1), (104, "http://x", "big " * 1_000_000, 1), (105, "http://x", "big " * 1_000_000, 1), (None, "http://x", "same", 1), (3, ROWS[3][1], ROWS[3][2], 1), (106, "u", "only\x00\n", 0)]


def run(spark, rows, path, parts=3):
    m.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), path)
    return m.read(spark, path)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "ARCHIVE_BYTES", 3000)
    records = run(spark, ROWS, f"{tmp_path}/a")
    got = m.assemble(records)
    assert sorted(map(lambda r: tuple(r)[:5], m.digest_columns(got).collect()), key=str) == want(ROWS)
    bodies = {(int(r.metadata.fields["pageId"]) if "pageId" in r.metadata.fields else None): bytes(r.response.payload) for r in got.where("response.record_type = 'response'").collect()}
    text = {i: (h or "").encode() for i, _, h, _ in ROWS}
    assert all(b == text[i] for i, b in bodies.items()) and records.where("record_type != 'warcinfo'").count() == 3 * len(ROWS)
    assert records.where("record_type = 'warcinfo'").count() == records.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/a").count()
    assert got.where("request is null or response is null or metadata is null").count() == 0
    m.remove(spark, f"{tmp_path}/a")
    assert not (tmp_path / "a").exists()


def test_chained_and_lonely_records(spark):
    rows = [("a", None, "request"), ("b", "a", "response"), ("c", "b", "metadata"), ("d", None, "response"), ("e", "gone", "metadata")]
    frame = spark.createDataFrame([(i, c, k, None, None, None, {}, None, None) for i, c, k in rows], m.RECORD)
    got = {r.capture_id: (r.request and r.request.record_id, r.response and r.response.record_id, r.metadata and r.metadata.record_id) for r in m.assemble(frame).collect()}
    assert got == {"a": ("a", "b", "c"), "d": (None, "d", None), "gone": (None, None, "e")}


def test_query_and_empty(spark):
    got = m.op5(spark, "/root/testdata/sf0.001").collect()
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(pages)
    assert [r.url for r in got if r.page_id == 5] == [u for i, u, _ in pages if i == 5]


def test_least(spark, tmp_path):
    m.write(spark.createDataFrame([(1, "", "ab", 0), (2, "", "ab", 0), (3, "", "abcd", 0), (4, "", "abcd", 0)], SCHEMA), f"{tmp_path}/b", least=3)
    got = m.digest_columns(m.assemble(m.read(spark, f"{tmp_path}/b")))
    assert sorted((r.page_id, r.record_type) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_empty_table(spark, tmp_path):
    assert m.digest_columns(m.assemble(run(spark, [], f"{tmp_path}/c"))).collect() == []


def test_revisits_name_their_response(spark, tmp_path):
    m.write(spark.createDataFrame([(1, "http://a/1", "same", 0), (2, "http://a/2", "same", 0), (3, "http://a/3", "other", 0), (2, "http://a/2", "same", 0)], SCHEMA), f"{tmp_path}/c")
    import gzip

    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "c").rglob("*.gz"))
    heads = [h for h, _ in m.parse(data)]
    responses = {h["warc-target-uri"]: h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    (revisit,) = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisit["warc-refers-to"] == responses["http://a/2"] and revisit["warc-refers-to-target-uri"] == "http://a/2" and revisit["warc-refers-to-date"] == m.DATE
    got = m.digest_columns(m.assemble(m.read(spark, f"{tmp_path}/c"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.record_type == "revisit") == [(1, "revisit", 2)] and len(got) == 4

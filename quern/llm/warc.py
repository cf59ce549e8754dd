"""WARC archives: writing, reading, and assembly of captures.

A page is written as a request, a response or revisit, and a metadata record, the last
two naming the request in WARC-Concurrent-To; a revisit names its response in
WARC-Refers-To. Archives begin with a warcinfo record. Each row of the written table is one
record in bytes; Spark's text writer puts them into files (its commit protocol survives
lost executors), gzipped, in archives of about ARCHIVE_BYTES, so that a reader holds one archive.
Reading follows Content-Length. Assembly joins records through their concurrent-to
identifiers, over up to two steps, and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, short_batches, stash

ARCHIVE_BYTES = 16 << 20
#: Payloads of at least this many bytes are written once; equal ones become revisits.
LEAST = 0
#: Rows that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Date of the records, fixed so that reruns write the same bytes but for identifiers.
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of the WARC 1.1 standard for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def safe_uri(url: str | None) -> str | None:
    """A URI as a header value: control characters and blanks are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def response_id(page_id: int | None, digest: str) -> str:
    """The identifier of a response, which follows from its page and payload, so that revisits know it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def archive_record() -> bytes:
    """The warcinfo record of an archive."""
    return record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: quern\r\nformat: WARC File Format 1.1\r\n")


def capture_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> list[bytes]:
    """The three records of one page."""
    uri, digest = safe_uri(url), base32_sha1(payload)
    request = f"<urn:uuid:{uuid.uuid4()}>"
    target = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^#]*)", uri or "")
    http = f"GET {(target and target[2]) or '/'} HTTP/1.1\r\nHost: {(target and target[1]) or ''}\r\n\r\n".encode()
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("pageId", page_id), ("payloadBytes", len(payload))) if v is not None).encode()
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Target-URI", uri)]
    body = [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Concurrent-To", request), ("Content-Type", "application/http; msgtype=response")]
    return [
        record("request", [("WARC-Record-ID", request), *common, ("Content-Type", "application/http; msgtype=request")], http),
        record("revisit", [("WARC-Record-ID", name()), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", safe_uri(refers_url)), ("WARC-Refers-To-Date", DATE), *body], reply)
        if revisit
        else record("response", [("WARC-Record-ID", response_id(page_id, digest)), *common, *body], reply + payload),
        record("metadata", [("WARC-Record-ID", name()), *common, ("WARC-Concurrent-To", request), ("Content-Type", "application/warc-fields")], fields),
    ]


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of rows(page_id, digest, size, url) whose payload the row with the largest page_id holds."""
    rows = pages.where(F.col("size") >= least)
    most = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", F.struct("page_id", "url")).alias("refers_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(most, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to", "refers_url").distinct()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """Writes every row of pages to archives under path. Null html is an empty payload, a null url an absent one.

    Each row makes a capture, repeated rows too; of equal payloads all rows with the
    largest page_id are responses (a null id is the smallest). Other columns are ignored.
    """
    short_batches(pages.sparkSession)
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    same = revisits(d.select("page_id", "digest", F.octet_length("payload").alias("size"), "url"), least).withColumn("revisit", F.lit(True))
    r = same.select(F.col("page_id").alias("p"), F.col("digest").alias("g"), "refers_to", "refers_url", "revisit")
    if r.count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    d = d.join(r, d["page_id"].eqNullSafe(r["p"]) & (d["digest"] == r["g"]), "left").select("page_id", d["url"], "payload", "refers_to", "refers_url", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, begun = 0, -1
        for batch in it:
            out, archive, held = [], [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = written // ARCHIVE_BYTES
                new = [archive_record()] if now != begun else []
                begun = now
                # the records of a capture stay in one archive
                for x in [*new, *capture_records(*row)]:
                    out.append(x[:-1])  # the text writer ends each value with the last line feed
                    archive.append(now)
                    held += len(x)
                    written += len(x)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archive, pa.int32())], ["value", "archive"])
                    out, archive, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archive, pa.int32())], ["value", "archive"])

    made = d.mapInArrow(make, "value binary, archive int")
    made.select(F.col("value").cast("string").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\n").option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            nxt = data.find(b"WARC/", at)
            if nxt < 0:
                return
            at = nxt
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


RECORD = "record_id string, concurrent_to string, record_type string, target_uri string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary, refers_to string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under path, gzipped or not. payload_bytes and payload_digest of responses are of the payload as read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in it:
            for value in batch.column(0):
                rows, held = [], 0
                data = value.as_buffer().to_pybytes()
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, payload, n, digest, fields = head.get("warc-type"), None, None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, {}
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        n, own = len(payload), base32_sha1(payload)
                        if digest != own:
                            raise ValueError(f"record {head.get('warc-record-id')}: digest {digest}, payload {own}")
                    elif head.get("content-type") == "application/warc-fields":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                    rows.append((head.get("warc-record-id"), head.get("warc-concurrent-to"), kind, head.get("warc-target-uri"), n, digest, list(fields.items()), payload if with_payload else None, head.get("warc-refers-to")))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the nested request, response (or revisit) and metadata records, null where absent.

    A record's capture is the one of the record it is concurrent to, over up to two
    steps; without that it is its own. A capture is a few records, so the grouping is
    uniform however many captures share a payload. Records about archives are left out.
    """
    records = records.where("record_type != 'warcinfo'")
    links = records.where("concurrent_to is not null").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("beyond"))
    d = records.join(links, F.col("concurrent_to") == F.col("via"), "left").withColumn("capture_id", F.coalesce("beyond", "concurrent_to", "record_id"))
    own = F.struct("record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "fields", "payload", "refers_to")
    pick = lambda cond, name: F.first(F.when(cond, own), ignorenulls=True).alias(name)
    return d.groupBy("capture_id").agg(pick(F.col("record_type") == "request", "request"), pick(F.col("record_type").isin("response", "revisit"), "response"), pick(F.col("record_type") == "metadata", "metadata"))


def digest_columns(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each capture that write() made.

    refers_to is the page of the response that a revisit's WARC-Refers-To names. Responses
    are one row each in that join, broadcast if few, so many revisits of one do not meet.
    """
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    d, _ = stash(
        captures.select(
            field("pageId").alias("page_id"),
            F.coalesce(F.col("response.payload_bytes"), field("payloadBytes")).alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.record_type").alias("record_type"),
            F.col("response.record_id").alias("own"),
            F.col("response.refers_to").alias("to"),
            F.col("response.target_uri").alias("url"),
        ),
        "captures",
    )
    wanted = d.where("record_type = 'revisit'").select("to").distinct()
    named = d.where("record_type = 'response'").select(F.col("own").alias("to"), F.col("page_id").alias("refers_to")).distinct().join(wanted, "to", "left_semi")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    return d.join(named, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quern-warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return digest_columns(assemble(read(spark, path, with_payload=False)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes archives."""
    discard(spark, path)


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS top, count(*) AS n FROM p GROUP BY x),
b AS (SELECT p.*, top, n, list_transform(range(0, 8), lambda k: ('0x' || substr(p.x, k * 5 + 1, 5))::BIGINT) AS v FROM p JOIN g ON p.x = g.x)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(v, lambda y: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to, url
FROM b
"""

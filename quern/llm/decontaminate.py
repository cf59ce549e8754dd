"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Documents fall in partitions by the size of their shingle set, with sizes doubling
from one to the next. A set's sketch is the least hash of each of 2^b slices of the
hash range, b by the document's partition and by the item's own size class, so that
about `load` shingles of the document fall in a slice whatever its length. A shingle
that an item and a document share is the document's least in its slice with
probability (1-e^-load)/load; a single equal slice makes a candidate. Items of 64
shingles or more (load 4) then miss with probability under 1e-6, items of 16 to 63
(load 1) under 3e-6; smaller items use all shingles and miss nothing. Candidates are
verified on whole sets.

Items are the stated query set. They travel to the executors in blocks of at most
BLOCK_CHARS characters; a larger set takes more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, batch_hashes, chunks, shingle_set, short_batches, text_hashes, window_hashes

THRESHOLD = (80, 100)
BLOCK_CHARS = 32_000_000
#: Size classes of items: least shingles, and shingles of a document per slice (0: all shingles are kept).
CLASSES = ((64, 4.0), (16, 1.0), (0, 0.0))
ALL = 64
BATCH = 512


def slices(n: int, load: float) -> int:
    """Bits of the slice number for a document partition (sizes 2^p to 2^(p+1)-1) and a class's load."""
    if not load:
        return ALL
    return max(0, int(n).bit_length() - int(np.log2(load)))


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """The least of each slice of a sorted set."""
    if bits == 0:
        return s[:1]
    if bits >= ALL:
        return s
    k = s >> np.uint64(64 - bits)
    return s[np.concatenate([[True], k[1:] != k[:-1]])] if len(s) else s


class Items:
    """The shingle sets of a block of items, and their sketches by number of slices."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.ids, self.sets, self.short = [], [], {}
        for i, text in rows:
            h = text_hashes(text)
            if len(h) == 0:
                continue
            if len(h) < SHINGLE:  # the whole sequence is its only shingle
                self.short.setdefault(len(h), {}).setdefault(int(window_hashes(h, len(h))[0]), []).append(i)
            else:
                self.ids.append(i)
                self.sets.append(np.unique(window_hashes(h, SHINGLE)))
        sizes = np.array([len(s) for s in self.sets], np.int64)
        self.by_class, upper = [], 1 << 62
        for least, load in CLASSES:
            self.by_class.append((load, np.flatnonzero((sizes >= least) & (sizes < upper))))
            upper = least
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def table(self, c: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        if (c, bits) not in self.tables:
            own = [(sketch(self.sets[k], bits), k) for k in self.by_class[c][1]]
            v = np.concatenate([x for x, _ in own]) if own else np.empty(0, np.uint64)
            at = np.concatenate([np.full(len(x), k) for x, k in own]) if own else np.empty(0, np.int64)
            order = np.argsort(v, kind="stable")
            self.tables[c, bits] = v[order], at[order]
        return self.tables[c, bits]

    def candidates(self, s: np.ndarray) -> set[int]:
        out: set[int] = set()
        for c, (load, members) in enumerate(self.by_class):
            if not len(members):
                continue
            bits = slices(len(s), load)
            v, at = self.table(c, bits)
            own = sketch(s, bits)
            lo, hi = np.searchsorted(v, own), np.searchsorted(v, own, "right")
            for x in np.flatnonzero(hi > lo):
                out.update(at[lo[x] : hi[x]].tolist())
        return out

    def hits(self, h: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, shared shingles, item's shingles) of each item that a text of these word hashes contains."""
        out = []
        for m, by_hash in self.short.items():
            for x in np.unique(window_hashes(h, m)).tolist() if len(h) >= m else ():
                out += [(i, 1, 1) for i in by_hash.get(x, ())]
        if len(h) >= SHINGLE:
            s = shingle_set(h)
            for k in self.candidates(s):
                q = self.sets[k]
                at = np.searchsorted(s, q)
                both = int((s[np.minimum(at, len(s) - 1)] == q).sum())
                if both * THRESHOLD[1] >= THRESHOLD[0] * len(q):
                    out.append((self.ids[k], both, len(q)))
        return out


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, a bounded number of characters at a time."""
    short_batches(items.sparkSession)
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_CHARS))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k)
        yield Items([(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in part.toLocalIterator()])


def containment(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of each document and each item it contains.

    An item is contained when 100 * shared >= 80 * its distinct five-word shingles; an
    item of fewer words must occur as a whole. Null or wordless texts contain nothing
    and are contained in nothing. Rows or items that repeat an id count once, with the
    largest share.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    out = d.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text):
        table = d.sparkSession.sparkContext.broadcast(block)

        def search(it: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in chunks(it, BATCH):
                ids, found = batch.column(0).to_pylist(), []
                for i, h in zip(ids, batch_hashes(batch, "text"), strict=True):
                    found += [(i, *x) for x in table.value.hits(h)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "shared", "item_shingles"])

        out = out.union(d.mapInArrow(search, schema))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("c"), "shared", "item_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.shared", "m.item_shingles", F.col("m.c").alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item. No shuffle: each row is judged where it is read."""
    for block in blocks(items, item_id, item_text):
        table = docs.sparkSession.sparkContext.broadcast(block)

        def clean(it: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in chunks(it, BATCH):
                yield batch.filter(pa.array([not table.value.hits(h) for h in batch_hashes(batch, text)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM ik),
n AS (SELECT item_id, count(*) AS total FROM i GROUP BY 1),
ks AS (SELECT DISTINCT k FROM ik),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM dw, ks WHERE len(w) >= k),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, total AS item_shingles, shared::DOUBLE / total AS containment FROM s JOIN n USING (item_id) WHERE 100 * shared >= 80 * total
"""

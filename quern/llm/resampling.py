"""Quality classifier by importance resampling.

Two hashed n-gram models, of the target text (labelled good documents) and of the raw
text (all documents), give every document the log ratio of its probability under
either. Documents are drawn without replacement in proportion to that ratio by Gumbel
top-k: the k largest of log ratio plus seeded Gumbel noise. The cut is found exactly by
counting 16 bits of the key at a time, so that neither the documents nor their keys
meet in one task or on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_hashes, chunks, short_batches, stash, window_hashes

BUCKETS = 1 << 15
#: Share of the documents with words that is drawn.
SHARE = 0.8
SEED = 29
BROADCAST_IDS = 2_000_000
BATCH = 512


def buckets_of(h: np.ndarray) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words."""
    return (np.concatenate([h, window_hashes(h, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def gumbel(doc_id: int | None, h: np.ndarray, seed: int = SEED) -> float:
    """Seeded noise from the id and the text's words, the same in every run."""
    word = int(h.sum(dtype=np.uint64)) if len(h) else 0
    a = zlib.crc32(f"{seed}:{doc_id}:{word}".encode())
    b = zlib.crc32(f"{word}|{doc_id}|{seed}".encode())
    u = (a * 2**20 + b % 2**20 + 0.5) / 2**52
    return float(-np.log(-np.log(u)))


def models(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability by bucket, from all documents; target holds the ids of the good ones."""
    ids = target.select(F.col(doc_id).alias("__t")).dropna().distinct().withColumn("good", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.join(ids, F.col("doc_id") == F.col("__t"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in chunks(it, BATCH):
            for h, good in zip(batch_hashes(batch, "text"), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(buckets_of(h), minlength=BUCKETS)
                n[0] += own
                if good:
                    n[1] += own
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0][at]), pa.array(n[1][at])], ["bucket", "raw", "target"])

    got = d.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    n = np.ones((2, BUCKETS))
    n[0, got["bucket"]] += got["raw"].astype(float)
    n[1, got["bucket"]] += got["target"].astype(float)
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def score(docs: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, sortable) per row. sortable is an integer in the order of key."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = table.value
        for batch in chunks(it, BATCH):
            n, w, k = [], [], []
            for i, h in zip(batch.column(0).to_pylist(), batch_hashes(batch, "text"), strict=True):
                b = buckets_of(h)
                n.append(len(b))
                w.append(float(r[b].sum()))
                k.append(w[-1] + gumbel(i, h, seed))
            key = np.array(k, np.float64)
            bits = key.view(np.int64)
            order = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key), pa.array(order)], ["doc_id", "n_grams", "log_weight", "key", "sortable"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double, sortable long")


def cut(rows: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """(value, rows above it) of the k-th largest of a long column; None without rows or k. Four counts of 2^16 groups at most."""
    if k <= 0:
        return None
    low, above, part = None, 0, rows
    for shift in (48, 32, 16, 0):
        got = sorted(part.groupBy(F.shiftright(column, shift).alias("top")).count().collect(), key=lambda r: -r["top"])
        for r in got:
            if above + r["count"] >= k:
                low = r["top"]
                break
            above += r["count"]
        else:
            return None
        part = rows.where(F.shiftright(column, shift) == low)
    return low, above


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) per row of docs; kept marks floor(share * rows with words) rows.

    Null and wordless texts have weight 0 and are never drawn. Rows equal in key (they
    repeat id and words) are drawn in the order of id as far as there is room. Without
    target documents every weight is 0 on average and the draw is near uniform.
    """
    short_batches(docs.sparkSession)
    got, _ = stash(score(docs, models(docs, target, doc_id, text), doc_id, text, seed), "scores")
    some = got.where("n_grams > 0")
    k = int(share * some.count())
    at = cut(some, "sortable", k)
    if at is None:
        return got.select("doc_id", "n_grams", "log_weight", "key", F.lit(False).alias("kept"))
    value, above = at
    # only rows that tie at the cut are ordered together
    tie = some.where(F.col("sortable") == value).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    tie = tie.withColumn("kept", F.col("rank") <= k - above).drop("rank")
    rest = got.where((F.col("n_grams") == 0) | (F.col("sortable") != value)).withColumn("kept", (F.col("n_grams") > 0) & (F.col("sortable") > value))
    return rest.unionByName(tie).select("doc_id", "n_grams", "log_weight", "key", "kept")


def good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), good(spark.read.parquet(f"{sf_dir}/labels.parquet")))

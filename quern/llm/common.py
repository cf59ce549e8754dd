"""Shared parts: word shingles, tables in the shared folder, components, exact weighted cuts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: White space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


# ---- tables in the shared folder ------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine (tests); else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files of a finished write go at once, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, was) if was is not None else spark.conf.unset(SHUFFLES_GO)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables made by stash() that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


# ---- words and shingles ---------------------------------------------------------


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit number for each byte, the same for A-Z as for a-z.
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
#: Bytes that are hashed in one go, so that the arrays stay in a core's cache; a longer text is one go.
_GO = 1 << 18


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base, mod 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 256), _BASE, np.uint64)
        _powers[0] = 1
        _powers = np.cumprod(_powers, dtype=np.uint64)
    return _powers


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in the bytes: a polynomial in the word's bytes, mixed."""
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.empty(0, np.uint64), at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    size = np.diff(np.concatenate([first, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[raw[at]] * _powers_to(int(size.max()))[place], first)
    return mix(h + size.astype(np.uint64)), at[first]


def text_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of one text, A-Z lower-cased, in order. Words end at 0x20 and 0x09-0x0D only."""
    return _hash_words(np.frombuffer(text, np.uint8))[0] if text else np.empty(0, np.uint64)


def batch_hashes(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """text_hashes() of each row of a batch; null: none."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = np.ones(n, bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _GO, "right")) - 1)
        raw = data[off[i] : off[j]]
        # a text's last word must not run on into the next text
        h, at = _hash_words(np.insert(raw, off[i + 1 : j] - off[i], 0x20) if j > i + 1 else raw)
        cut = np.searchsorted(at, off[i : j + 1] - off[i] + np.arange(j - i + 1))
        for k in range(j - i):
            yield h[cut[k] : cut[k + 1]] if valid[i + k] else h[:0]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, in text order."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1), np.uint64)
    for i in range(k):
        # odd multipliers that follow from the position
        out += h[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) * (2 * i + 1)) & (2**64 - 1) | 1)
    return mix(out)


def shingle_set(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct k-word shingles of a text's word hashes; a shorter text is one shingle of its whole sequence; no words: empty."""
    if len(h) == 0:
        return h
    s = np.sort(window_hashes(h, min(k, len(h))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def binary_values(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


# ---- connected components ---------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str | None]:
    """(node, component) for every node of edges(a, b); component is the smallest node it reaches.

    Large-star and small-star steps until the edges no longer change, each a
    partial aggregate and a join, so neither a hub nor a large component meets in
    one task. Self-loops name nodes too. Null ends are dropped. Also returns the
    path of the table behind the result, for discard().
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stash(e, "links")
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen["n"]:
            break
        both = now.where("a != b").select("a", "b").union(now.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: what is left below each node meets at its smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = small.union(least.select("a", F.col("m").alias("b"))).union(now.where("a = b")).distinct()
        nxt, to = stash(step, "links")
        discard(spark, path)
        now, path, was, seen = nxt, to, seen, mark(nxt)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    got = now.where("a != b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    loops = now.where("a = b").select("a").distinct().join(got, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return got.union(roots.union(loops).distinct()), path


# ---- exact cuts of a seeded order ---------------------------------------------------

BUCKETS = 4096


def cut_running(rows: DataFrame, group: Column, order: list[Column], weight: Column, levels: int = 2) -> DataFrame:
    """Adds `before`: the weight of the rows of the same group that come earlier in the seeded order.

    order[0] must be a uniform long in [0, 2**62); the rest breaks ties. A running
    sum over a whole hot group would meet in one task, so sums go bucket by bucket:
    level one sums 4096 slices of the order per group, and each slice is summed by
    level two; only rows of one slice of a slice are ordered together.
    """
    from pyspark.sql import Window

    d = rows.withColumn("__g", group).withColumn("__h", order[0]).withColumn("__w", weight)
    d = d.withColumn("__b1", F.shiftright("__h", 50)).withColumn("__b2", F.shiftright("__h", 38))
    by2 = d.groupBy("__g", "__b1", "__b2").agg(F.sum("__w").alias("__s2"))
    by1 = by2.groupBy("__g", "__b1").agg(F.sum("__s2").alias("__s1"))
    earlier = lambda s, part, o: F.coalesce(F.sum(s).over(Window.partitionBy(*part).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by1 = by1.withColumn("__o1", earlier("__s1", ["__g"], "__b1")).select("__g", "__b1", "__o1")
    by2 = by2.withColumn("__o2", earlier("__s2", ["__g", "__b1"], "__b2")).select("__g", "__b1", "__b2", "__o2")
    base = by2.join(by1, by2["__g"].eqNullSafe(by1["__g"]) & (by2["__b1"] == by1["__b1"])).select(by2["__g"].alias("__gb"), by2["__b2"].alias("__bb"), (F.col("__o1") + F.col("__o2")).alias("__base"))
    within = Window.partitionBy("__g", "__b2").orderBy("__h", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__w").over(within), F.lit(0)))
    d = d.join(base, d["__g"].eqNullSafe(base["__gb"]) & (d["__b2"] == base["__bb"]))
    return d.withColumn("before", F.col("__base") + F.col("__in")).drop("__g", "__h", "__w", "__b1", "__b2", "__in", "__gb", "__bb", "__base")


#: Rows that cross to Python at once. Texts may be long, and both sides hold a batch.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches in this session; a smaller bound that is already set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def chunks(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what Python makes of one stays bounded. Memory that is free again goes back when the input ends."""
    b = None
    try:
        for b in it:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    finally:
        del b
        give_back()


def give_back() -> None:
    """Returns free memory of this process to the system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)

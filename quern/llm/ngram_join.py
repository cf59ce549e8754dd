"""N-gram Jaccard join: exact, size-aware, heavy-light.

Documents are sets of five-word shingles; two link when 100*|A∩B| >= 80*|A∪B|.

1. Equal sets collapse into classes; from here on one representative stands for each.
2. A global order of shingles puts those seen often last. For sets that share o
   shingles, the first |A|-o+k of A and |B|-o+k of B in any common order share k.
   Small sets therefore enumerate the 2-subsets of that prefix (k=2); large sets
   post single shingles (k=1) to inverted lists, and so do small sets near the
   boundary, for partners beyond it. The boundary is the largest size at which
   enumeration costs less, from measured shingle frequencies.
3. Lists are scanned for pairs that a size test and a bitmap bound leave; each scan
   keeps only as many pairs as hold its members together. Their components are the
   clusters in which all links lie.
4. Within a cluster whole sets are compared; what is kept of the links holds the
   linked together. Their components are the answer. No list, cluster or partner is capped.

Only pairs that nothing yet holds together are compared, so a group of near copies
takes work in proportion to its size. In a list or cluster that one group of a task
holds, a few members meet all others first, and then only what stayed outside the
largest component meets the rest. Longer ones are contracted before: a pivot meets all
members in a join, twice; then the blocks of what joined meet only the blocks of what
did not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, batch_hashes, chunks, components, discard, mix, shingle_set, short_batches, stash, window_hashes

THRESHOLD = (80, 100)
#: Rows of the frequency table that orders shingles (12 MB at most). It decides costs, never results.
ORDER_ROWS = 1_000_000
#: Relative cost of one posting and of one comparison in a list; members of a list that a posting meets, as near copies are met by few.
POST, SCAN, MET = 1.0, 0.1, 64
#: Members of a list, and bytes of sets in a cluster, that one group of a task holds twice at most; more are contracted and dealt in blocks.
BLOCK, BLOCK_BYTES = 8192, 4 << 20
#: Pivots that meet a whole list or cluster before it is dealt in blocks, and members that meet a group before the rest do.
ROUNDS, SEEDS = 2, 8
#: 64-bit words of a set's bitmap, and how often per pair it may lose a link of large sets at most.
BITMAP, LOSS = 8, 1e-12
BATCH = 512
#: Ids that may be broadcast (about 64 MB); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def least_overlap(n, t=THRESHOLD):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * t[0] // t[1])


def frequencies(docs: DataFrame, text: str, min_local: int = 3, min_total: int = 16) -> tuple[DataFrame, DataFrame, str]:
    """Shingles seen often, as (h, n), and one row of (occurrences, meetings) per task.

    A task counts its own rows, and those it saw at least min_local times are summed.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, met = [], 0, 0.0

        def flush():
            nonlocal seen, total, met
            if not seen:
                return None
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            seen = []
            total, met = total + int(n.sum()), met + float((n * np.minimum(n, MET)).sum())
            keep = n >= min_local
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64)), pa.nulls(int(keep.sum()), pa.float64())], ["h", "n", "met"])

        held = 0
        for batch in chunks(it, BATCH):
            for h in batch_hashes(batch, text):
                s = window_hashes(h, min(SHINGLE, max(len(h), 1)))
                held += len(s)
                seen.append(s)
            if held > 2_000_000:
                yield flush()
                held = 0
        if (last := flush()) is not None:
            yield last
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total]), pa.array([met])], ["h", "n", "met"])

    got, path = stash(docs.select(text).mapInArrow(count, "h long, n long, met double"), "counts")
    often = got.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_total)
    return often, got.where("h is null").select("n", "met"), path


def boundary(mean_frequency: float) -> int:
    """The largest size at which 2-subsets of the prefix cost less than scanning single lists."""
    best = 4
    for n in range(4, 400):
        p1, p2 = n - least_overlap(n) + 1, n - least_overlap(n) + 2
        if POST * p2 * (p2 - 1) / 2 <= p1 * (POST + SCAN * mean_frequency):
            best = n
    return best


def profiles(docs: DataFrame, doc_id: str, text: str, often: tuple[np.ndarray, np.ndarray], small: int) -> DataFrame:
    """(doc_id, n, s1, s2, keys, common, bits) per document, s1 and s2 naming its set.

    keys: its signatures; common: how many of its shingles are frequent ones; bits: its bitmap.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(often)

    def profile(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = table.value
        # most shingles are in no table: a small bit table spares their search
        flags = np.zeros(1 << 22, bool)
        flags[known >> np.uint64(42)] = True
        for batch in chunks(it, BATCH):
            ids, n, s1, s2, keys, common, bits = batch.column(0), [], [], [], [], [], []
            for h in batch_hashes(batch, text):
                s = shingle_set(h)
                m = len(s)
                n.append(m)
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if m else 0)
                s2.append(int(np.bitwise_xor.reduce(s * np.uint64(0x9FB21C651E98DF25) ^ (s >> np.uint64(28))).view(np.int64)) if m else 0)
                f = np.zeros(m, np.int64)
                maybe = np.flatnonzero(flags[s >> np.uint64(42)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                    f[maybe] = np.where(known[at] == s[maybe], count[at], 0)
                common.append(int((f > 0).sum()))
                if m < 4:  # at 80 percent such a set has only equal partners
                    keys.append(np.empty(0, np.int64))
                    bits.append(b"")
                    continue
                order = np.argsort(f, kind="stable")  # s is sorted by hash, so ties follow the hash
                own, spare = [], m - int(least_overlap(m))
                if m <= small:
                    p = s[order[: spare + 2]]
                    i, j = np.triu_indices(len(p), 1)
                    own.append(window_hashes_pair(np.minimum(p[i], p[j]), np.maximum(p[i], p[j])))
                if m * THRESHOLD[1] > small * THRESHOLD[0]:  # a partner may lie beyond the boundary
                    own.append(s[order[: spare + 1]])
                keys.append(np.concatenate(own).view(np.int64))
                x = np.zeros(BITMAP * 64, np.uint8)
                at = s >> np.uint64(64 - int(spread(m)))
                x[at[: np.searchsorted(at, BITMAP * 64)]] = 1
                bits.append(np.packbits(x, bitorder="little").tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), pa.array(common, pa.int64()), pa.array(bits, pa.binary())],
                ["doc", "n", "s1", "s2", "keys", "common", "bits"],
            )

    return docs.select(F.col(doc_id).alias("doc"), text).mapInArrow(profile, "doc long, n long, s1 long, s2 long, keys array<long>, common long, bits binary")


def spread(n):
    """Bits of the range over which a set of n is spread: at least two places a shingle. The bitmap holds the first places."""
    return np.maximum(np.ceil(np.log2(2 * np.maximum(n, 1))), np.log2(BITMAP * 64)).astype(np.int64)


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with bitmaps x and y can be as similar as asked.

    Places that differ are shingles that differ. Where the bitmaps hold whole sets the
    answer is certain. They hold a share of larger sets, the same part of the hash range
    for both; the number of differing shingles in it then exceeds its mean by more than
    Chernoff's bound allows with probability LOSS at most.
    """
    keep = np.minimum(n, m) * THRESHOLD[1] >= np.maximum(n, m) * THRESHOLD[0]
    a, b = spread(n), spread(m)
    wide = np.maximum(a, b)
    apart = np.zeros(len(n), np.int64)
    for case in (0, 1, -1):  # the finer bitmap is folded onto the coarser one; sizes within 80 percent are one step apart at most
        at = np.flatnonzero(keep & (a - b == case))
        if len(at):
            u, v = x[at], y[at]
            if case:
                fine, coarse = (u, v) if case > 0 else (v, u)
                u, v = fold(fine), coarse[:, : BITMAP // 2]
            apart[at] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
    total = n + m
    need = -(-total * THRESHOLD[0] // (THRESHOLD[0] + THRESHOLD[1]))
    most = total - 2 * need  # shingles that may differ
    share = np.minimum(BITMAP * 64 / np.exp2(wide), 1.0)
    mean, ln = most * share, -np.log(LOSS)
    slack = ln / 3 + np.sqrt(ln * ln / 9 + 2 * ln * mean)
    return keep & (abs(a - b) <= 1) & (apart <= np.where(share < 1, mean + slack, most))


def fold(bits: np.ndarray) -> np.ndarray:
    """A bitmap with neighbouring places merged, in half the words."""
    x = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").reshape(len(bits), -1, 2).max(axis=2)
    return np.packbits(x, axis=1, bitorder="little").view(np.uint64)


def window_hashes_pair(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A key for each 2-subset, apart from the keys of single shingles."""
    return mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + mix(high) + np.uint64(0x165667B19E3779F9))


def groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by their first column, cut so that no group of equal values is split."""
    rest: list[pa.RecordBatch] = []
    for batch in it:
        g = batch.column(0).to_numpy()
        if not len(g):
            continue
        cut = np.flatnonzero(g[1:] != g[:-1]) + 1
        if len(cut) or rest and rest[-1].column(0)[-1].as_py() != g[0]:
            at = int(cut[-1]) if len(cut) else 0
            done = pa.Table.from_batches([*rest, batch.slice(0, at)])
            if done.num_rows:
                yield done
            rest = [batch.slice(at)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of n nodes under the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, was, label)  # roots follow their members
        label = label[label]
        if np.array_equal(was, label):
            break
    return label


def tie(known: np.ndarray, hits: Callable[[np.ndarray], np.ndarray], step: int) -> np.ndarray:
    """Smallest member of each member's component under the links that hits() tells, and known ones.

    known names what is already held together; hits(k) gives a row of links to all
    members for each of at most `step` members k. A few members meet all first. A pair
    of different components then has a member outside the largest, and those meet all.
    """
    m = len(known)
    order = np.argsort(known, kind="stable")
    same = np.flatnonzero(known[order][1:] == known[order][:-1])
    ii, jj, done = [order[same]], [order[same + 1]], np.zeros(m, bool)
    label = spanning(ii[0], jj[0], m)

    def meet(k: np.ndarray) -> None:
        a, b = np.nonzero(hits(k))
        done[k] = True
        at = np.flatnonzero(label[k[a]] != label[b])
        ii.append(k[a[at]])
        jj.append(b[at])

    for _ in range(SEEDS):
        alone = np.flatnonzero(~done & (np.bincount(label, minlength=m)[label] == 1))
        if not len(alone):
            break
        meet(alone[:1])
        label = spanning(np.concatenate(ii), np.concatenate(jj), m)
    rest = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
    for c in range(0, len(rest), step):
        meet(rest[c : c + step])
    return spanning(np.concatenate(ii), np.concatenate(jj), m)


#: Groups of up to this many members are compared all at once, and pairs that are compared in one go.
FEW, GO = 8, 1 << 17


def scan_lists(lists: DataFrame, hot: bool) -> DataFrame:
    """Pairs (a, b) of rows (key, cnt, doc, n, bits) that hold together what shares a key and may link; hot: a list may exceed BLOCK."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lists.select(F.col("key").alias("g"), "doc", F.col("doc").alias("lab"), "n", "bits") if not hot else lists.where(F.col("cnt") <= BLOCK).select(F.col("key").alias("g"), "doc", F.col("doc").alias("lab"), "n", "bits")
    forest = None
    if hot:
        dealt, forest = long_lists(lists.where(F.col("cnt") > BLOCK).select("key", "doc", "n", "bits"))
        d = d.unionByName(dealt)
    d = d.repartition(parts, "g").sortWithinPartitions("g")

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(it):
            g, doc, lab, n = (t.column(k).to_numpy() for k in range(4))
            bits = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64).reshape(len(g), BITMAP)
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.concatenate([start, [len(g)]]))
            few = np.repeat(size <= FEW, size)
            aa, bb = [], []
            for step in range(1, FEW):
                i = np.flatnonzero(few[:-step] & (g[step:] == g[:-step])) if len(g) > step else start[:0]
                j = i + step
                ok = may_link(n[i], n[j], bits[i], bits[j])
                aa.append(doc[i[ok]])
                bb.append(doc[j[ok]])
            for s0, m in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                own = slice(s0, s0 + m)
                on, ob = n[own], bits[own]
                if m * m <= GO:
                    i, j = np.triu_indices(m, 1)
                    ok = may_link(on[i], on[j], ob[i], ob[j])
                    label = spanning(i[ok], j[ok], m)
                else:

                    def hits(k, on=on, ob=ob, m=m):
                        i, j = np.repeat(k, m), np.tile(np.arange(m), len(k))
                        return may_link(on[i], on[j], ob[i], ob[j]).reshape(len(k), m)

                    label = tie(lab[own], hits, max(1, GO // m))
                k = np.flatnonzero(label != np.arange(m))
                aa.append(doc[own][k])
                bb.append(doc[own][label[k]])
            a, b = np.concatenate(aa), np.concatenate(bb)
            u = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).query("a != b").drop_duplicates()
            if len(u):
                yield pa.RecordBatch.from_pandas(u, preserve_index=False)

    got = d.mapInArrow(scan, "a long, b long")
    return (got if forest is None else got.unionByName(forest)).distinct()


def long_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (g, doc, lab, n, bits) of lists(key, doc, n, bits) dealt in blocks, and the pairs that pivots have tied already.

    A pivot of each list meets the list, then one of what it left. What is tied to the
    first pivot, on whatever way, is not compared among itself.
    """

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            n, pn = (t.column(k).to_numpy() for k in (2, 5))
            bits, pb = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint64).reshape(len(n), BITMAP) for k in (3, 6))
            yield pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(may_link(n, pn, bits, pb))], ["key", "doc", "n", "bits", "pivot", "tied"])

    active, met, first = lists, [], None
    for k in range(ROUNDS):
        pivots = active.groupBy("key").agg(F.min_by(F.struct("doc", "n", "bits"), F.xxhash64("doc", F.lit(k))).alias("p")).select("key", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.bits").alias("pb"))
        rows = active.join(pivots, "key").select("key", "doc", "n", "bits", "pivot", "pn", "pb")
        got, _ = stash(rows.mapInArrow(meet, "key long, doc long, n long, bits binary, pivot long, tied boolean"), "pivots")
        met.append(got.where("tied").select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct())
        first = first if first is not None else got.select("key", "pivot").distinct()
        active = got.where("not tied").select("key", "doc", "n", "bits")
    forest, _ = stash(reduce(DataFrame.unionByName, met).where("a != b").distinct(), "tied")
    comp, _ = components(forest)
    of = lambda node, name: comp.select(F.col("node").alias(node), F.col("component").alias(name))
    first = first.join(of("pivot", "top"), "pivot", "left").select("key", F.coalesce("top", "pivot").alias("top"))
    d = lists.join(of("doc", "lab"), "doc", "left").withColumn("lab", F.coalesce("lab", "doc")).join(first, "key").withColumn("main", F.col("lab") == F.col("top"))
    blocks = lambda cond: F.ceil(F.sum(F.when(cond, 1).otherwise(0)) / BLOCK).cast("int")
    d = d.join(d.groupBy("key").agg(blocks(F.col("main")).alias("nc"), blocks(~F.col("main")).alias("nt")), "key")
    own = F.pmod(F.xxhash64("doc", F.lit(3)), F.when(F.col("main"), F.col("nc")).otherwise(F.col("nt"))).cast("int")
    return deal(d.withColumn("own", own), "key").select("g", "doc", "lab", "n", "bits"), forest


def deal(d: DataFrame, key: str) -> DataFrame:
    """A row, with its group g, for each pair of blocks that a row of (key, main, own, nc, nt) belongs to: all pairs but those of main blocks.

    There is a main block at least, and the other blocks meet themselves when they meet it.
    """
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own, others = F.col("own"), F.filter(upto(F.col("nt")), lambda o: o != F.col("own"))
    mixed = F.transform(upto(F.when(F.col("main"), F.col("nt")).otherwise(F.col("nc"))), lambda o: F.xxhash64(key, F.lit("main"), F.when(F.col("main"), own).otherwise(o), F.when(F.col("main"), o).otherwise(own)))
    rest = F.transform(others, lambda o: F.xxhash64(key, F.lit("rest"), F.least(own, o), F.greatest(own, o)))
    return d.withColumn("g", F.explode(F.concat(mixed, F.when(F.col("main"), F.array().cast("array<bigint>")).otherwise(rest))))


def compare(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Smallest member of each set's component under the links of the sets, and known ones."""
    n = np.array([len(x) for x in sets])
    # an inverted index of the group: a member counts what it shares with all others at once
    own = np.repeat(np.arange(len(sets)), n)
    _, element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(df)])
    posting = own[np.argsort(element, kind="stable")]
    first = np.concatenate([[0], np.cumsum(n)])

    def hits(k: np.ndarray) -> np.ndarray:
        e = element[first[k[0]] : first[k[0] + 1]]
        length = df[e]
        where = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(at[e], length)
        both = np.bincount(posting[where], minlength=len(sets))
        return (both * THRESHOLD[1] >= THRESHOLD[0] * (n[k[0]] + n - both))[None]

    return tie(known, hits, 1)


def packed(docs: DataFrame, text: str, cells: DataFrame, columns: str) -> DataFrame:
    """(doc, <columns>, shingles) for the documents in cells(__d, <columns>), which are broadcast if few."""
    if cells.count() <= BROADCAST_IDS // 4:
        cells = F.broadcast(cells)
    names = [c.split()[0] for c in columns.split(", ")]
    texts = docs.select("doc", text).join(cells, F.col("doc") == F.col("__d")).select("doc", *names, text)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, BATCH):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([shingle_set(h).tobytes() for h in batch_hashes(batch, text)], pa.binary())], ["doc", *names, "shingles"])

    return texts.mapInArrow(pack, f"doc long, {columns}, shingles binary")


def long_clusters(docs: DataFrame, text: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, g) of members(doc, n, component) dealt in blocks, with lab, what pivots have tied; and those pairs.

    Sizes fall in bands a quarter apart, so that links lie within a band or between
    neighbours. In each band the largest tied part is its main part, which is not
    compared among itself, nor with the main part of the next band if they are tied.
    """

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            tied = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * THRESHOLD[1] >= max(len(a), len(b)) * THRESHOLD[0] else 0
                tied.append(both * THRESHOLD[1] >= THRESHOLD[0] * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(tied, pa.bool_())], ["doc", "pivot", "tied"])

    active, met = members.select("doc", "component"), []
    for k in range(ROUNDS):
        pivots, _ = stash(active.groupBy("component").agg(F.min_by("doc", F.xxhash64("doc", F.lit(k))).alias("pivot")), "pivots")
        sets, _ = stash(packed(docs, text, pivots.select(F.col("pivot").alias("__d"), "component"), "component long").select(F.col("doc").alias("pivot"), "component", F.col("shingles").alias("ps")), "sets")
        rows = packed(docs, text, active.select(F.col("doc").alias("__d"), "component"), "component long").join(sets, "component").select("doc", "pivot", "shingles", "ps")
        got, _ = stash(rows.mapInArrow(meet, "doc long, pivot long, tied boolean"), "met")
        met.append(got.where("tied and doc != pivot").select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")))
        active = active.join(got.where("not tied").select("doc"), "doc", "left_semi")
    forest, _ = stash(reduce(DataFrame.unionByName, met), "tied")
    comp, _ = components(forest)
    m = members.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(THRESHOLD[1] / THRESHOLD[0])) + 1e-9).cast("int"))
    m = m.join(comp.select(F.col("node").alias("doc"), F.col("component").alias("lab")), "doc", "left").withColumn("lab", F.coalesce("lab", "doc"))
    w = m.groupBy("component", "band", "lab").agg(F.sum(F.col("n") * 8).alias("bytes")).groupBy("component", "band").agg(F.max_by("lab", F.struct("bytes", "lab")).alias("top"), F.max("bytes").alias("most"), F.sum("bytes").alias("all"))
    w = w.select("component", "band", "top", F.ceil(F.col("most") / BLOCK_BYTES).cast("int").alias("nc"), F.ceil((F.col("all") - F.col("most")) / BLOCK_BYTES).cast("int").alias("nt"))
    w, _ = stash(w, "bands")
    m = m.join(w, ["component", "band"]).withColumn("main", F.col("lab") == F.col("top"))
    m = m.withColumn("own", F.pmod(F.xxhash64("doc", F.lit(3)), F.when(F.col("main"), F.col("nc")).otherwise(F.col("nt"))).cast("int")).withColumn("kb", F.xxhash64("component", "band"))
    within = deal(m, "kb").select("doc", "lab", "g")
    # blocks of a band are numbered, main ones first; a pair of neighbouring bands is named by the lower
    m = m.select("doc", "lab", "component", "band", "top", "main", "nc", F.when(F.col("main"), F.col("own")).otherwise(F.col("nc") + F.col("own")).alias("block"))
    across = []
    for up in (1, -1):
        other = w.select("component", (F.col("band") - up).alias("band"), F.col("top").alias("otop"), F.col("nc").alias("onc"), (F.col("nc") + F.col("nt")).alias("blocks"))
        x = m.join(other, ["component", "band"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x = x.where(~(F.col("main") & (F.col("o") < F.col("onc")) & (F.col("top") == F.col("otop"))))
        low, high = ("block", "o") if up == 1 else ("o", "block")
        across.append(x.select("doc", "lab", F.xxhash64("component", F.least(F.col("band"), F.col("band") + up), F.lit("across"), low, high).alias("g")))
    return reduce(DataFrame.unionByName, across, within), forest


def link_clusters(docs: DataFrame, text: str, members: DataFrame) -> tuple[DataFrame, str]:
    """Links (a, b) that hold together what links within clusters; members is (doc, n, component). Also the path of the table behind them."""
    spark = docs.sparkSession
    size = members.groupBy("component").agg((F.sum("n") * 8).alias("bytes"))
    large, p0 = stash(size.where(F.col("bytes") > BLOCK_BYTES), "large")
    forest = None
    if large.limit(1).count():
        dealt, forest = long_clusters(docs, text, members.join(large.select("component"), "component", "left_semi"))
        cells = members.join(large.select("component"), "component", "left_anti").select("doc", F.col("doc").alias("lab"), F.col("component").alias("g")).unionByName(dealt)
    else:
        cells = members.select("doc", F.col("doc").alias("lab"), F.col("component").alias("g"))
    cells, p1 = stash(cells.groupBy(F.col("doc").alias("__d"), "lab").agg(F.collect_list("g").alias("gs")), "cells") if forest is not None else (cells.select(F.col("doc").alias("__d"), "lab", F.array("g").alias("gs")), "")
    d = packed(docs, text, cells, "lab long, gs array<long>").select(F.explode("gs").alias("g"), "doc", "lab", "shingles")
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(b for x in it for b in chunks(iter([x]), 2048)):
            g, doc, lab = (t.column(k).to_numpy() for k in range(3))
            sets = [np.frombuffer(x, np.uint64) for x in t.column(3).to_pylist()]
            start = np.concatenate([np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), [len(g)]])
            aa, bb = [], []
            for s0, s1 in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if s1 - s0 == 2:
                    x, y = sets[s0], sets[s0 + 1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    label = np.zeros(2, np.int64) if both * THRESHOLD[1] >= THRESHOLD[0] * (len(x) + len(y) - both) else np.arange(2)
                else:
                    label = compare(sets[s0:s1], lab[s0:s1])
                k = np.flatnonzero(label != np.arange(s1 - s0))
                aa.append(doc[s0:s1][k])
                bb.append(doc[s0:s1][label[k]])
            if aa and sum(map(len, aa)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(aa)), pa.array(np.concatenate(bb))], ["a", "b"])

    links = d.mapInArrow(link, "a long, b long")
    got, path = stash(links if forest is None else links.unionByName(forest), "similar")
    discard(spark, *[p for p in (p0, p1) if p])
    return got, path


def join_unique(docs: DataFrame) -> DataFrame:
    """(doc, n, component) for rows (doc, text) whose ids are unique and not null; component: the smallest id reached."""
    spark = docs.sparkSession
    often, work, p0 = frequencies(docs, "text")
    top = often.orderBy(F.desc("n"), "h").limit(ORDER_ROWS).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    total = work.agg(F.sum("n").alias("n"), F.sum("met").alias("s")).first()
    small = boundary((total["s"] or 0) / max(total["n"] or 0, 1))
    prof, p1 = stash(profiles(docs, "doc", "text", (h[order], top.column("n").to_numpy()[order]), small), "profiles")
    del top
    discard(spark, p0)

    named = ["n", "s1", "s2"]
    # classes of more than one row; a class may be large, but it is one row here, and so cheap to broadcast
    multi, p2 = stash(prof.where("n > 0").groupBy(*named).agg(F.min("doc").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "classes")
    several = few(multi)
    # the copies are told from their representatives by id, so that no signature is shuffled for it
    copies = few(prof.where("n >= 4").select("doc", *named).join(several, named).where("doc != rep").select("doc"))
    reps = prof.where("n >= 4").join(copies, "doc", "left_anti")

    post = reps.select(F.explode("keys").alias("key"), "doc")
    shared = post.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    lists, p3 = stash(post.join(shared, "key"), "lists")
    longest = lists.agg(F.max("cnt")).first()[0] or 0
    bm = reps.select("doc", "n", "bits")
    forest, p4 = stash(scan_lists(lists.join(bm, "doc").select("key", "cnt", "doc", "n", "bits"), longest > BLOCK), "forest")
    discard(spark, p3)
    clusters, p5 = components(forest)
    members, p8 = stash(clusters.withColumnRenamed("node", "doc").join(bm.select("doc", "n"), "doc"), "members")
    links, p6 = link_clusters(docs, "text", members)
    comp, p7 = components(links)

    # a row of several takes what its representative has, all others what they have themselves: no copies meet at a key
    linked = lambda node, name: comp.select(F.col("node").alias(node), F.col("component").alias(name))
    of = few(multi.join(linked("rep", "c"), "rep", "left").select(*named, F.coalesce("c", "rep").alias("class")))
    out = prof.select("doc", *named).join(of, named, "left").join(few(linked("doc", "own")), "doc", "left")
    out, _ = stash(out.select("doc", "n", F.coalesce("class", "own", "doc").alias("component")), "joined")
    discard(spark, *[p for p in (p1, p2, p4, p5, p6, p7, p8) if p])
    return out


def few(ids: DataFrame) -> DataFrame:
    """Broadcast when BROADCAST_IDS rows at most; else the join shuffles, and adaptive execution splits a hot key of the other side."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def odd(docs: DataFrame, doc_id: str) -> bool:
    """Whether an id repeats or is null."""
    return bool(docs.groupBy(doc_id).agg(F.count("*").alias("__n")).where(F.col(doc_id).isNull() | (F.col("__n") > 1)).limit(1).count())


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Null or wordless text: 0 shingles, linked with nothing. Each row is judged by its
    own text, also where ids repeat or are null: component_id is the smallest id that is
    not null among the rows reached, null if there is none. Other columns are ignored,
    whatever their names. Ties (equal sets, shingles seen equally often) fall by id and hash.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not odd(docs, "doc_id"):
        return join_unique(docs.withColumnRenamed("doc_id", "doc")).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rows, path = stash(docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text"), "rows")
    got = join_unique(rows.select("doc", "text")).join(rows.select("doc", "doc_id"), "doc")
    least = got.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out, _ = stash(got.join(few(least), "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "joined")
    discard(docs.sparkSession, path)
    return out


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one whose id names the component. Documents without words stay.

    Where ids repeat or are null, one row of each group stays, of the smallest id, null ids last.
    """
    short_batches(docs.sparkSession)
    if not odd(docs, doc_id):
        # ids are judged apart, so that texts are shuffled only where the ids are too many to broadcast
        got = join_unique(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")))
        gone = few(got.where("n > 0 and doc != component").select(F.col("doc").alias("__gone")))
        return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")
    rows, _ = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    got = join_unique(rows.select(F.col("__row").alias("doc"), F.col(text).alias("text"))).where("n > 0").join(rows.select(F.col("__row").alias("doc"), F.col(doc_id).alias("__id")), "doc")
    kept = got.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "doc")).alias("k")).select(F.col("k.doc").alias("__kept"))
    gone = few(got.join(kept, F.col("doc") == F.col("__kept"), "left_anti").select(F.col("doc").alias("__gone")))
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""

"""Toxicity: a chain of linear classifiers, one per category.

Categories are predicted in order; each later model also sees the probabilities of
the categories before it, in training those predicted out of fold, so that it learns
from probabilities as uncertain as those it will meet. Features are hashed: the letters
of a word, lower-cased, whole and their first three to seven. Selection of features and
all fits take place within folds.

Learning uses at most SAMPLE labelled documents (a seeded sample beyond); counts are
made in the executors, and the driver holds the counts of features that LEAST sampled
documents have (under 2^20) and one bit row of the chosen ones per sampled document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, mix, short_batches, stash
from .language import in_goes, tables

FEATURES = 1 << 20
SAMPLE = 12_000
FOLDS = 4
#: Features of one model, and the fewest sampled documents a feature must occur in.
CHOSEN, LEAST = 400, 4
#: Letters of the beginnings of words that are features.
BEGINNINGS = range(3, 8)
#: Weight decay of the fits.
DECAY = 1.0
#: Clean documents may be rejected at this rate at most, out of fold.
FALSE_RATE = 0.002
BATCH = 512
#: Rows that the driver holds at once as floating-point numbers.
BLOCK = 1024


def text_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, feature) for each word's features, with repeats, some texts at a time."""
    is_letter, _ = tables()
    for first, lot in in_goes(texts):
        low = [t.lower() for t in lot]
        cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D))
        at = np.flatnonzero(is_letter[np.minimum(cp, len(is_letter) - 1)])
        if not len(at):
            continue
        word = np.cumsum(blank)[at]  # what lies between blanks
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.concatenate([begin, [len(at)]]))
        text = first + np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at[begin], "right")
        sign = cp[at].astype(np.uint64)
        h, live = np.zeros(len(begin), np.uint64), np.arange(len(begin))
        longest = int(size.max())
        for k in range(longest):
            live = live[size[live] > k]
            h[live] = (h[live] + sign[begin[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
            if k + 1 in BEGINNINGS:
                yield text[live], feature(h[live], 1)
        yield text, feature(h, 2)


def feature(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) >> np.uint64(44)).astype(np.int64)


@dataclass
class Linear:
    """A logistic model over some features and the probabilities of earlier categories."""

    chosen: np.ndarray
    weights: np.ndarray  # chosen, then earlier probabilities, then the constant

    def logit(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return x @ self.weights[: len(self.chosen)] + earlier @ self.weights[len(self.chosen) : -1] + self.weights[-1]


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    auc: dict[str, float] = field(default_factory=dict)

    def features(self) -> np.ndarray:
        return np.unique(np.concatenate([m.chosen for m in self.models] or [np.empty(0, np.int64)])).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Weights of a logistic model with a constant (last), by Newton steps with weight decay, some rows at a time."""
    wide = x.shape[1] + 1
    w = np.zeros(wide)
    reg = np.full(wide, decay)
    reg[-1] = 1e-6
    if len(x):
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(12):
        g, h = reg * w, np.diag(reg)
        for k in range(0, len(x), BLOCK):
            a = np.concatenate([x[k : k + BLOCK], np.ones((len(x[k : k + BLOCK]), 1))], axis=1)
            p = sigmoid(a @ w)
            g += a.T @ (p - y[k : k + BLOCK])
            h += (a * (p * (1 - p))[:, None]).T @ a
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors among those that reject FALSE_RATE of the rest at most; in the widest gap of equals."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.flatnonzero(np.concatenate([p[1:] != p[:-1], [True]]))  # a threshold never parts equal scores
    wrong = np.cumsum(1 - y)[last]
    missed = y.sum() - np.cumsum(y)[last]
    top, below = np.concatenate([[1.0], p[last]]), np.concatenate([p[:1], p[np.minimum(last + 1, len(p) - 1)]])
    below[-1] = 0.0
    wrong, missed = np.concatenate([[0], wrong]), np.concatenate([[y.sum()], missed])
    errors = np.where(wrong <= FALSE_RATE * (1 - y).sum(), wrong + missed, np.inf)
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax((top - below)[best])]
    return float((top[k] + below[k]) / 2) if k else float(np.nextafter(max(p[0], 0.5), 2))


def choose(n: np.ndarray, pos: np.ndarray, docs: int, positives: int) -> np.ndarray:
    """The features whose rate among positives differs most from that among the rest, in standard errors."""
    neg, rest = n - pos, max(docs - positives, 1)
    p, q = (pos + 0.1) / (positives + 0.2), (neg + 0.1) / (rest + 0.2)
    z = np.abs(p - q) / np.sqrt(p * (1 - p).clip(1e-9) / max(positives, 1) + q * (1 - q).clip(1e-9) / rest)
    z[n < LEAST] = 0
    at = np.argsort(-z, kind="stable")[:CHOSEN]
    return np.sort(at[z[at] > 2.5])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """The chain learned from labels(doc_id, ...); categories maps a name to the SQL condition that makes a row positive.

    Labels with a null id or category are not learned from, one row of an id is; no
    labels, or none that is positive: nothing is ever flagged. A document that repeats
    under its id counts each time. Features that set classes apart equally fall by number.
    """
    spark, names = docs.sparkSession, list(categories)
    short_batches(spark)
    y = labels.select(F.col(doc_id).alias("__d"), *[F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).dropna().dropDuplicates(["__d"])
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("__d", F.lit(11)), F.lit(1_000_000)) < int(1e6 * sample / n))
    y = y.withColumn("fold", F.pmod(F.xxhash64("__d", F.lit(13)), F.lit(FOLDS)).cast("int"))
    # the sample is bounded, and so is what is broadcast
    rows = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("text")).join(F.broadcast(y), "__d").select("text", "fold", *[f"y{k}" for k in range(len(names))])

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, BATCH):
            pairs = [np.unique(t * FEATURES + f) for t, f in text_features(batch.column(0).to_pylist())]
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            offsets = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * FEATURES).astype(np.int32)
            f = pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs % FEATURES).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([f, *batch.columns[1:]], ["f", *batch.schema.names[1:]])

    ys = [f"y{k}" for k in range(len(names))]
    held, path = stash(rows.mapInArrow(extract, "f array<int>, fold int, " + ", ".join(f"{c} int" for c in ys)), "features")
    of = lambda k, c: F.sum(F.when(F.col("fold") == k, F.lit(1) if c == "n" else F.col(c)).otherwise(0)).cast("int").alias(f"{c}_{k}")
    sums = held.select(F.explode("f").alias("f"), "fold", *ys).groupBy("f").agg(F.count("*").alias("all"), *[of(k, c) for k in range(FOLDS) for c in ("n", *ys)])
    sums = sums.where(F.col("all") >= LEAST).drop("all").toArrow().sort_by("f")  # fewer than FEATURES rows of small integers
    known = sums.column("f").to_numpy().astype(np.int64)
    count = np.array([[sums.column(f"{c}_{k}").to_numpy() for k in range(FOLDS)] for c in ("n", *ys)])
    del sums
    by = {r["fold"]: r for r in held.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ys]).collect()}  # a row per fold
    sizes = {c: np.array([by[k][c] if k in by else 0 for k in range(FOLDS)]) for c in ("n", *ys)}

    folds = [*range(FOLDS), None]  # None: all folds, the final models
    picked = {}
    for out in folds:
        use = [f for f in range(FOLDS) if f != out]
        for k, c in enumerate(ys):
            picked[out, k] = known[choose(count[0][use].sum(axis=0, dtype=float), count[1 + k][use].sum(axis=0, dtype=float), int(sizes["n"][use].sum()), int(sizes[c][use].sum()))]
    union = np.unique(np.concatenate(list(picked.values()))).astype(np.int64)
    del count, known
    table = spark.sparkContext.broadcast(union)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = table.value
        for batch in chunks(it, BATCH):
            bits = []
            for f in batch.column(0).to_pylist():
                bits.append(np.packbits(np.isin(u, np.array(f or [], np.int64))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), *batch.columns[1:]], ["bits", *batch.schema.names[1:]])

    got = held.mapInArrow(pack, "bits binary, fold int, " + ", ".join(f"{c} int" for c in ys)).orderBy("bits", "fold", *ys).toArrow()  # SAMPLE rows, about
    discard(spark, path)
    n = got.num_rows
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(n, -1) if n and len(union) else np.zeros((n, 0), np.uint8)
    fold, models, thresholds, auc = got.column("fold").to_numpy(), [], [], {}
    earlier = np.zeros((n, 0), np.float32)  # out-of-fold probabilities of the categories before

    def part(at: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Rows of chosen features, and the probabilities before."""
        return np.concatenate([(bits[np.ix_(at, cols >> 3)] >> (7 - (cols & 7)).astype(np.uint8)) & 1, earlier[at]], axis=1, dtype=np.float32, casting="unsafe")

    for k, name in enumerate(names):
        t, oof = got.column(f"y{k}").to_numpy().astype(float), np.zeros(n)
        for out in folds:
            cols, use = np.searchsorted(union, picked[out, k]), np.ones(n, bool) if out is None else fold != out
            m = Linear(picked[out, k], fit(part(np.flatnonzero(use), cols), t[use]))
            if out is None:
                models.append(m)
            else:
                x = part(np.flatnonzero(~use), cols)
                oof[~use] = sigmoid(m.logit(x[:, : len(cols)], x[:, len(cols) :]))
        thresholds.append(cut(oof, t))
        if 0 < t.sum() < len(t):
            rank = oof.argsort().argsort()
            auc[name] = float((rank[t == 1].sum() - t.sum() * (t.sum() - 1) / 2) / (t.sum() * (len(t) - t.sum())))
        earlier = np.concatenate([earlier, oof[:, None]], axis=1, dtype=np.float32, casting="unsafe")
    return Chain(names, models, thresholds, auc)


class Judge:
    """Scores texts with a chain."""

    def __init__(self, chain: Chain):
        self.chain, self.features = chain, chain.features()
        self.cols = [np.searchsorted(self.features, m.chosen) for m in chain.models]
        self.flag = np.zeros(FEATURES, bool)
        self.flag[self.features] = True

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.features)), np.float32)
        for t, f in text_features(texts):
            at = np.flatnonzero(self.flag[f])
            x[t[at], np.searchsorted(self.features, f[at])] = 1
        p = np.zeros((len(texts), 0))
        for m, cols in zip(self.chain.models, self.cols, strict=True):
            p = np.concatenate([p, sigmoid(m.logit(x[:, cols], p))[:, None]], axis=1)
        p[[not t or not t.strip() for t in texts]] = 0
        return p


def classify(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) per row. Null or blank text: probabilities 0, nothing is flagged.

    Each row is judged by its text alone: repeated rows give equal rows, ids may repeat or
    be null, a score equal to the threshold is flagged, and other columns are ignored,
    whatever their names. An empty table gives an empty one.
    """
    table = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(table.value)
        for batch in chunks(it, BATCH):
            p = judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(names))], *[pa.array(p[:, k] >= table.value.thresholds[k]) for k in range(len(names))]], ["doc_id", *[f"p_{c}" for c in names], *[f"is_{c}" for c in names]])

    schema = "doc_id long, " + ", ".join([f"p_{c} double" for c in names] + [f"is_{c} boolean" for c in names])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)


def remove(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not flagged; repeated rows stay or go together."""
    table, k = docs.sparkSession.sparkContext.broadcast(chain), chain.categories.index(category)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(table.value)
        for batch in chunks(it, BATCH):
            yield batch.filter(pa.array(judge(batch.column(batch.schema.get_field_index(text)).to_pylist())[:, k] < table.value.thresholds[k]))

    return docs.mapInArrow(keep, docs.schema)


#: The labels give one toxicity category, and quality; this comes first, so that toxicity sees it.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    return train(docs, labels, CATEGORIES)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, chain_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

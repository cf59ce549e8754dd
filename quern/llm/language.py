"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts hashed character n-grams of words per language on a bounded sample
of labelled documents, in the executors; the model is a table of 2^16 features by
languages. A word's score for a language is its mean log likelihood over its n-grams
times their root number, against the best language at most CLIP apart. Languages
whose training text holds next to nothing in the word's script are no candidates.
The best path over a document's words pays SWITCH for each change of language; words
without letters, or of a script no language has, say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, short_batches

FEATURES = 1 << 16
#: Labelled documents that are learned from, at most about (a seeded sample beyond).
SAMPLE = 12_000
SWITCH = 8.0
#: A document without a language that holds this share of its letters is rejected.
KEEP_SHARE = 0.4
CLIP = 6.0
#: Share of a language's letters that makes a script its own.
SCRIPT_SHARE = 0.001
BATCH = 1024

# First and last code point of letters by script (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x2FA1F)],
}
NAMES = list(SCRIPTS)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point, to the end of the third plane: whether it is a letter, and its script (len(NAMES) for none of them)."""
    global _tables
    if _tables is None:
        top = 0x40000
        script = np.full(top, len(NAMES), np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for lo, hi in ranges:
                script[lo : hi + 1] = k
        _tables = np.array([chr(c).isalpha() for c in range(top)]), script
    return _tables


_tables: tuple[np.ndarray, np.ndarray] | None = None
#: Characters that are worked on at once, so that the arrays stay in a core's cache.
GO = 1 << 17


@dataclass
class Words:
    """Words of some texts: the n-grams of their letters, with a word's ends marked, as feature numbers."""

    per_text: np.ndarray  # words by text
    letters: np.ndarray  # letters by word
    lettered: np.ndarray  # index of the words with letters; what follows is by these
    scripts: np.ndarray  # bit set
    start: np.ndarray  # first place
    grams: list[np.ndarray]  # by place, the feature of the 1, 2, 3 and 4 signs from there; FEATURES where the word ends before


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter, script = tables()
    space = (cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D))
    first = ~space
    first[1:] &= space[:-1]
    word = np.cumsum(first) - 1
    ends = np.cumsum([len(t) + 1 for t in low])
    upto = np.concatenate([[0], word[ends - 1] + 1]) if len(ends) else np.zeros(1, np.int64)
    small = np.minimum(cp, len(is_letter) - 1)
    at = np.flatnonzero(is_letter[small])
    own, signs = word[at], cp[at]
    letters = np.bincount(own, minlength=int(upto[-1]))
    lettered = np.flatnonzero(letters)
    m = letters[lettered]
    begin = np.cumsum(m) - m
    bits = np.bitwise_or.reduceat(np.uint32(1) << script[small[at]].astype(np.uint32), begin) if len(m) else np.empty(0, np.uint32)
    # each word's letters between two marks
    n = len(signs) + 2 * len(m)
    g = np.repeat(np.arange(len(m)), m)
    seq = np.empty(n, np.uint32)
    seq[np.arange(len(signs)) + 2 * g + 1] = signs
    start = begin + 2 * np.arange(len(m))
    last = start + m + 1
    seq[start], seq[last] = 1, 2
    to = np.repeat(last, m + 2)  # a word's closing mark
    grams, h, place = [], np.zeros(n, np.uint32), np.arange(n)
    for k in range(4):
        nxt = np.zeros(n, np.uint32)
        nxt[: n - k] = seq[k:]
        h = (h ^ nxt) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        f = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)
        f[place + k > to] = FEATURES
        if k == 0:
            f[start] = f[last] = FEATURES
        grams.append(f)
    return Words(np.diff(upto), letters, lettered, bits, start, grams)


def in_goes(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts (null: empty), some at a time, each lot with the number of its first."""
    lot, size, first = [], 0, 0
    for k, t in enumerate(texts):
        lot.append(t or "")
        size += len(lot[-1])
        if size >= GO:
            yield first, lot
            lot, size, first = [], 0, k + 1
    if lot:
        yield first, lot


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features and one row of zeros x languages: log probabilities
    scripts: np.ndarray  # scripts x languages: is a candidate

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score by word and language: 0 for the best, down to -CLIP; all 0 for words that say nothing. And which words have a candidate."""
        out, has = np.zeros((len(w.letters), len(self.languages)), np.float32), np.zeros(len(w.letters), bool)
        if not len(w.lettered) or not self.languages:
            return out, has
        by_place = self.weights[w.grams[0]]
        for f in w.grams[1:]:
            by_place += self.weights[f]
        total = np.add.reduceat(by_place, w.start, axis=0)
        m = w.letters[w.lettered]
        total /= np.sqrt(3 * m + 1 + np.maximum(m - 1, 0), dtype=np.float32)[:, None]
        sets, which = np.unique(w.scripts, return_inverse=True)
        may = np.stack([self.scripts[[k for k in range(len(NAMES) + 1) if int(x) >> k & 1]].any(axis=0) for x in sets])[which]
        total = np.where(may, total, -np.inf)
        best = total.max(axis=1)
        known = np.isfinite(best)
        out[w.lettered[known]] = np.maximum(total[known] - best[known, None], -CLIP)
        has[w.lettered[known]] = True
        return out, has


def train(docs: DataFrame, text: str, lang: str, learn: Column, key: Column, sample: int = SAMPLE) -> Model:
    """The model of the rows of docs that `learn` selects; key seeds the sample when there are more than `sample`."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < int(1e6 * sample / n))
    wide = FEATURES + 1 + len(NAMES) + 1  # features, one for none, scripts

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(it, BATCH):
            by: dict[str, list[str]] = {}
            for la, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(la, []).append(t)
            for la, texts in by.items():
                own = total.setdefault(la, np.zeros(wide, np.int64))
                for _, lot in in_goes(texts):
                    w = words_of(lot)
                    for f in w.grams:
                        own[: FEATURES + 1] += np.bincount(f, minlength=FEATURES + 1)
                    m = w.letters[w.lettered]
                    for k in range(len(NAMES) + 1):
                        own[FEATURES + 1 + k] += int(m[(w.scripts >> np.uint32(k)) & np.uint32(1) == 1].sum())
        for la, own in total.items():
            own[FEATURES] = 0
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([la] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "f", "n"])

    counted = rows.select(lang, text).mapInArrow(count, "lang string, f int, n long")
    got = counted.groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()  # features x languages at most
    languages = sorted(set(rows.select(lang).distinct().toPandas()[lang]))
    table = np.zeros((wide, len(languages)))
    if len(got):
        table[got["f"].to_numpy(), got["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy()] = got["n"].to_numpy()
    f = table[:FEATURES] + 0.5
    s = table[FEATURES + 1 :]
    weights = np.concatenate([np.log(f / f.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32)
    return Model(languages, weights, s > SCRIPT_SHARE * np.maximum(s.sum(axis=0), 1))


def paths(scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best language of each word of each document: Viterbi over all documents at once, step by step."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    live = int((lengths > 0).sum())
    if not live:
        return out
    flat = np.concatenate([scores[i] for i in order[:live]])
    start = np.concatenate([[0], np.cumsum(lengths[:live])[:-1]])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents longer than t
    v = flat[start].astype(np.float64)
    final = np.zeros(live, np.int64)
    stay, jump = [], []
    for t in range(1, int(lengths[0])):
        k = int(active[t])
        if k < len(v):
            final[k : len(v)] = v[k:].argmax(axis=1)
            v = v[:k]
        top = v.argmax(axis=1)
        best = v[np.arange(k), top] - SWITCH
        keep = v >= best[:, None]
        stay.append(keep)
        jump.append(top.astype(np.uint16))
        v = np.maximum(v, best[:, None]) + flat[start[:k] + t]
    final[: len(v)] = v.argmax(axis=1)
    labels = np.zeros(len(flat), np.int64)
    now = final
    for t in range(int(lengths[0]) - 1, 0, -1):
        k = int(active[t])
        own = now[:k]
        labels[start[:k] + t] = own
        at = np.arange(k)
        now[:k] = np.where(stay[t - 1][at, own], own, jump[t - 1])
    labels[start] = now
    for j in range(live):
        out[order[j]] = labels[start[j] : start[j] + lengths[j]]
    return out


def judge(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) per text; spans are (language, first word, words).

    Letters of words without a candidate count in the whole, but for no language.
    """
    scores, letters, counted = [], [], []
    for _, lot in in_goes(texts):
        w = words_of(lot)
        cut = np.cumsum(w.per_text)[:-1]
        got, has = model.scores(w)
        letters += np.split(w.letters, cut)
        counted += np.split(w.letters * has, cut)
        scores += np.split(got, cut)
    best = paths(scores) if model.languages else [np.empty(0, np.int64)] * len(texts)
    out = []
    for n, c, p in zip(letters, counted, best, strict=True):
        total = int(n.sum())
        if not total or not len(p):
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(p, c, minlength=len(model.languages))
        k = int(share.argmax())
        cut = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
        out.append((model.languages[k], float(share[k] / total), [(model.languages[p[a]], int(a), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]))
    return out


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row: the language of most letters, their share, and all spans.

    Null text, or none with a letter: `und`, score 0, no spans. Letters of a script that no
    language has count for none, so a text of such letters alone has score 0, under the
    first language. Languages that tie fall by name. Each row is judged by its text alone:
    repeated rows give equal rows, ids may repeat or be null, and other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, BATCH):
            got = judge(batch.column(1).to_pylist(), table.value)
            spans = [[{"lang": a, "first": b, "words": c} for a, b, c in s] for _, _, s in got]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = KEEP_SHARE) -> DataFrame:
    """The rows of docs, all columns, with a language that holds at least that share of the letters."""
    table = docs.sparkSession.sparkContext.broadcast(model)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, BATCH):
            yield batch.filter(pa.array([la != "und" and s >= least for la, s, _ in judge(batch.column(batch.schema.get_field_index(text)).to_pylist(), table.value)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def model_of(docs: DataFrame) -> Model:
    """The model of documents, learned from all but the held-out fold."""
    short_batches(docs.sparkSession)
    return train(docs, "text", "lang", remainder("doc_id") != 2, F.col("doc_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs, model_of(docs))
    return got.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))

"""Vector search, BM25 and ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

col, lit = F.col, F.lit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where the dimensions differ, 0 for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(lit(0.0)))


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10, min_similarity: float = 0.0, scope: DataFrame | None = None) -> DataFrame:
    """(id, similarity) of the top_k of vectors(id, embedding); scope(id) restricts the candidates by a semi-join.

    The query is a literal, so the scan computes one dot product and one norm per row.
    """
    d = vectors if scope is None else vectors.join(scope.select("id"), "id", "left_semi")
    q = F.array(*[lit(float(x)) for x in query])
    norm = float(sum(float(x) * float(x) for x in query)) ** 0.5
    e = col("embedding")
    n = F.sqrt(dot(e, e)) * lit(norm)
    s = F.when(n > 0, dot(e, q) / n).otherwise(lit(0.0))
    d = d.where(F.size(e) == len(query)).select("id", F.round(s, 6).alias("similarity")).where(col("similarity") >= min_similarity)
    return d.orderBy(F.desc("similarity"), "id").limit(top_k)


#: Queries that one pass over the vectors answers.
QUERIES_AT_ONCE = 1024


def vector_searches(vectors: DataFrame, queries: DataFrame, top_k: int = 10, min_similarity: float = 0.0, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity): the top_k of vectors(id, embedding) for each row of queries(query_id, query).

    Queries go in blocks of QUERIES_AT_ONCE, each a broadcast of bounded size that meets
    every vector once; a task keeps its own top_k of each query, so what is shuffled is
    top_k rows a query and task. Vectors of another length than the query's are no candidates.
    """
    spark = vectors.sparkSession
    d = (vectors if scope is None else vectors.join(scope.select("id"), "id", "left_semi")).select("id", "embedding")
    n = queries.count()
    blocks = -(-n // QUERIES_AT_ONCE) or 1
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, similarity double"
    out = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), lit(blocks)) == k)
        rows = own.select("query_id", "query").orderBy("query_id").toArrow().to_pydict()  # a block of queries, bounded
        by = {}
        for i, q in zip(rows["query_id"], rows["query"], strict=True):
            by.setdefault(len(q), []).append((i, np.array(q, float)))
        table = spark.sparkContext.broadcast({m: ([i for i, _ in qs], np.stack([q / (np.sqrt((q * q).sum()) or 1.0) for _, q in qs])) for m, qs in by.items()})

        def run(it: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            best = []
            for p in it:
                size = p["embedding"].map(len).to_numpy() if len(p) else np.empty(0, int)
                for m, (ids, q) in table.value.items():
                    at = np.flatnonzero(size == m)
                    if not len(at):
                        continue
                    x = np.array(p["embedding"].iloc[at].tolist(), float)
                    norm = np.sqrt((x * x).sum(axis=1))
                    s = np.round((x @ q.T) / np.where(norm > 0, norm, 1.0)[:, None], 6)
                    own = pd.DataFrame({"query_id": np.repeat(np.array(ids), len(at)), "id": np.tile(p["id"].to_numpy()[at], len(ids)), "similarity": s.T.ravel()})
                    best.append(own[own["similarity"] >= min_similarity].sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(top_k))
                if len(best) > 8:
                    best = [pd.concat(best).sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(top_k)]
            if best:
                yield pd.concat(best)

        got = d.mapInPandas(run, kind)
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("__k", F.row_number().over(w)).where(col("__k") <= top_k).drop("__k")


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, len) of docs(id, text)."""
    d = docs.select("id", tx.tokens(col("text")).alias("w"))
    return d.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of documents that hold a term of the query. Rare terms weigh by Okapi's idf; negative ones by a share of the mean.

    Term statistics of all terms are needed only for the mean; the scoring pass keeps the query's terms, read once each.
    """
    size = docs.select(F.size(tx.tokens(col("text"))).alias("len")).agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    df = docs.select("id", F.explode(F.array_distinct(tx.tokens(col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "n", (col("total") / col("n")).alias("avg"), (F.ln(col("n") - col("df") + 0.5) - F.ln(col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    terms = docs.sparkSession.range(1).select(F.explode(tx.tokens(lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    weight = idf.join(F.broadcast(terms), "term").crossJoin(F.broadcast(mean)).select("term", "avg", (col("times") * F.when(col("idf") < 0, epsilon * col("mean")).otherwise(col("idf"))).alias("w"))
    # a query has few terms
    asked = tx.tokens(lit(query))
    p = docs.select("id", tx.tokens(col("text")).alias("t")).select("id", F.size("t").alias("len"), F.explode(F.filter("t", lambda w: F.array_contains(asked, w))).alias("term")).join(F.broadcast(weight), "term")
    tf = p.groupBy("id", "len", "term", "avg", "w").agg(F.count("*").alias("tf"))
    s = col("w") * col("tf") * (k1 + 1) / (col("tf") + k1 * (1 - b + b * col("len") / col("avg")))
    return tf.groupBy("id").agg(F.sum(s).alias("score"))


def match_all(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Full-text match: ids of documents that hold every term."""
    w = tx.tokens(col("text"))
    return docs.where(F.size(F.array_intersect(w, F.array(*[lit(t.lower()) for t in terms]))) == len({t.lower() for t in terms})).select("id")


def local_impact(papers: DataFrame, group: str, citations: str = "citations") -> DataFrame:
    """Adds impact: the percentile of a paper's citations in its group, ties by their mean rank; 0.5 alone.

    Equal counts collapse before ranking, so a window sees a row per distinct count.
    """
    c = F.greatest(lit(0), F.coalesce(col(citations), lit(0)))
    d = papers.withColumn("__c", c)
    counts = d.groupBy(group, "__c").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group)
    below = F.coalesce(F.sum("__n").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    total = F.sum("__n").over(w)
    rank = counts.withColumn("__b", below).withColumn("__t", total).select(group, "__c", F.when(col("__t") == 1, lit(0.5)).otherwise((2 * col("__b") + col("__n") - 1) / 2 / (col("__t") - 1)).alias("impact"))
    return d.join(rank, [group, "__c"]).drop("__c")


def rank_candidates(scores: DataFrame, first: int = 150, bm25_weight: float = 0.3, embedding_weight: float = 0.7) -> DataFrame:
    """(query, id, combined, final, rank) of scores(query, id, bm25, embedding, weight): best by BM25, combined, times the category's weight.

    Rows keep the order of `combined`; final may not fall along it.
    """
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), "id"))
    d = scores.withColumn("__k", best).where(col("__k") <= first)
    d = d.withColumn("combined", bm25_weight * col("bm25") + embedding_weight * col("embedding"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("combined"), "id"))
    return d.select("query", "id", F.round("combined", 9).alias("combined"), F.round(col("combined") * col("weight"), 9).alias("final"), rank.alias("rank"))


def knee(values: list[float], least: int = 3, most: int = 50) -> int:
    """How many of a falling list to keep: up to where it lies farthest below the line between its ends, normalised."""
    v = np.asarray(values[:most], float)
    if len(v) <= least:
        return len(v)
    if v.max() == v.min():
        return least
    x = np.linspace(0, 1, len(v))
    y = (v - v.min()) / (v.max() - v.min())
    gap = (1 - y) - x  # a convex falling curve, flipped to a concave rising one
    peaks = [i for i in range(1, len(v) - 1) if gap[i] >= gap[i - 1] and gap[i] >= gap[i + 1]]
    if not peaks:
        return min(len(v), most)
    step = float(np.diff(x).mean())
    for n, i in enumerate(peaks):
        until = peaks[n + 1] if n + 1 < len(peaks) else len(v)
        if any(gap[j] < gap[i] - step for j in range(i + 1, until)):
            return max(least, min(i + 1, most))
    return max(least, min(peaks[-1] + 1, most))


def cut_at_knee(ranked: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """The rows of ranked(query, id, final, rank) above each query's knee; a query has `most` rows at most before the cut."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"query": p["query"], "keep": [knee([x["final"] for x in sorted(r, key=lambda x: x["rank"])], least, most) for r in p["rows"]]})

    lists = ranked.where(col("rank") <= most).groupBy("query").agg(F.collect_list(F.struct("rank", "final")).alias("rows"))
    keep = lists.mapInPandas(run, f"query {ranked.schema['query'].dataType.simpleString()}, keep int")
    return ranked.join(keep, "query").where(col("rank") <= col("keep")).drop("keep")


#: Vectors of a block; a task holds two blocks.
BLOCK_ROWS = 4096


def knn(vectors: DataFrame, k: int, least: float, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity): each vector's k nearest others at `least` or above, block by block of vectors, in Arrow batches.

    Exact, so all blocks meet; their number grows with the vectors, so that a task's two do not.
    """
    blocks = blocks or max(8, -(-vectors.count() // BLOCK_ROWS))
    v = vectors.select("id", F.pmod(F.xxhash64("id"), lit(blocks)).alias("blk"), "embedding")
    d = v.withColumn("other", F.explode(F.sequence(lit(0), lit(blocks - 1)))).select("id", "embedding", col("blk"), "other")
    d = d.select("id", "embedding", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), (col("blk") <= col("other")).alias("left"), (col("blk") == col("other")).alias("same"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = np.array(p["embedding"].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, left, same = p["id"].to_numpy(), p["left"].to_numpy(), bool(p["same"].iloc[0])
        a, b = (np.arange(len(p)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        out = []
        for s, t in ((a, b),) if same else ((a, b), (b, a)):
            sim = np.round(m[s] @ m[t].T, 9)
            for r, i in enumerate(s):
                row = sorted(((-x, ids[j]) for x, j in zip(sim[r], t, strict=True) if j != i and x >= least))[:k]
                out += [(ids[i], j, -x) for x, j in row]
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"similarity": float})

    kind = vectors.schema["id"].dataType.simpleString()
    near = d.groupBy("x", "y").applyInPandas(run, f"a {kind}, b {kind}, similarity double")
    return near.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(col("__k") <= k).drop("__k")


def pca_layout(vectors: DataFrame, least: int = 5) -> DataFrame | None:
    """(id, x, y) in 0 to 100 by the first two principal components of z-scored vectors; None under `least` rows. Signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if vectors.limit(least).count() < least:
        return None
    d = vectors.select("id", array_to_vector(col("embedding").cast("array<double>")).alias("v"))
    d = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(d).transform(d)
    d = PCA(k=2, inputCol="z", outputCol="p").fit(d).transform(d).select("id", vector_to_array("p").alias("p"))
    lo = d.agg(*[f(col("p")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = lambda i: F.when(lit(lo[f"hi{i}"] > lo[f"lo{i}"]), (col("p")[i] - lo[f"lo{i}"]) / (max(lo[f"hi{i}"] - lo[f"lo{i}"], 1e-300)) * 100).otherwise(lit(50.0))
    return d.select("id", scale(0).alias("x"), scale(1).alias("y"))

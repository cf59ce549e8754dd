"""Quality rules: learned decision lists. DataFrame operations only.

Statistics of whole texts come first (op8's base). A decision list is then learned
from labelled documents by sequential covering: a rule, a conjunction of at most
three threshold conditions, is grown condition by condition for information gain on
the growing part of the sample, pruned on the other part for precision, and the rows
it covers are taken away before the next. All counts are Spark aggregates over the
labelled statistics; the driver holds counts per candidate condition only. The list
is emitted as one ordered conditional expression, CASE WHEN rule THEN false ... ELSE
true END.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, stash

WINDOW = 8
MIN_WORDS = 20
#: Labelled documents learned from, at most about (a seeded sample beyond).
SAMPLE = 40_000
MAX_RULES, MAX_CONDITIONS = 8, 3
#: Candidate thresholds per statistic: quantiles of the labelled sample.
QUANTILES = 16
#: On the pruning part a rule must cover this share of the sample's rejected rows, be this precise, and with one added to both counts this worthy.
LEAST_COVER, LEAST_PRECISION, LEAST_WORTH = 0.01, 0.95, 0.75

#: Statistics that rules may test, all defined (0 for no words) on every text.
STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "punct_share": "n_punct / greatest(word_chars, 1)",
    "stutter_share": "n_stutter / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "cast(n_words as double)",
}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda's variable is not copied into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in WINDOW-word runs found twice or more in the array."""

    def doubled(a: Column, k: int) -> Column:
        # hashes of twice as long runs, from neighbours k apart
        return F.zip_with(F.slice(a, F.lit(1), F.size(a) - k), F.slice(a, F.lit(1 + k), F.size(a) - k), lambda x, y: F.xxhash64(x, y))

    each = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(each, lambda h: let(doubled(h, 1), lambda p: let(doubled(p, 2), lambda q: doubled(q, 4))))
    runs = F.when(F.size(words) >= WINDOW, eight).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        # places of repeated runs, ascending: each adds what the next one leaves of its words
        last = F.size(places)
        return F.aggregate(
            F.sequence(F.lit(1), last),
            F.lit(0).cast("bigint"),
            lambda acc, k: acc + F.when(k == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(places, k) - F.get(places, k - 1))).cast("bigint"),
        )

    def marked(z: Column) -> Column:
        # z: (hash, place) sorted, so equal runs are neighbours
        n = F.size(z)
        return F.filter(
            F.transform(
                z,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(z, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < n - 1) & (F.get(z, F.least(i + 1, n - 1))["h"] == x["h"])),
                    x["i"],
                ),
            ),
            lambda p: p.isNotNull(),
        )

    def count(h: Column) -> Column:
        zipped = lambda: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = lambda: let(zipped(), lambda z: F.array_sort(marked(z)))
        # most texts repeat nothing and stop at the first test
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(places(), covered))

    return let(runs, count)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts for rules) per row; null text counts as empty."""
    space = " \t\n\x0b\f\r"
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(space))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(space)) != "")
    found = lambda signs: F.regexp_count("t", F.lit(signs)).cast("bigint")
    d = d.withColumn("words", words).withColumn("lines", let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))))
    return d.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        (F.length("t") - found(SPACE)).cast("bigint").alias("word_chars"),
        found(r"[#*$%&|<>]").alias("n_symbols"),
        (F.col("lines.n") - F.col("lines.own")).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.col("lines.n").cast("bigint").alias("n_lines"),
        found("[A-Z]").alias("n_upper"),
        found("[0-9]").alias("n_digits"),
        found("[.,;:!?]").alias("n_punct"),
        # words equal to the one before: unlike the share of distinct words, it does not change with a text's length
        F.size(F.filter("words", lambda w, i: (i > 0) & (F.get(F.col("words"), F.greatest(i - 1, F.lit(0))) == w))).cast("bigint").alias("n_stutter"),
    )


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def sql_of(rule: Rule) -> str:
    return " and ".join(c.sql() for c in rule) or "true"


def counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """(rejected, good) rows that each of a few rules covers, in one aggregate."""
    got = rows.agg(*[F.count_if(F.expr(f"({sql_of(r)}) and {c}")).alias(f"{n}{i}") for i, r in enumerate(rules) for n, c in (("b", "bad"), ("g", "not bad"))]).first()
    return [(got[f"b{i}"], got[f"g{i}"]) for i in range(len(rules))]


def tally(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(rejected, good) rows that each condition on a cut covers.

    Rows carry, by statistic, how many cuts are at most and how many are below its
    value; rows with the same ranks are counted together, and sums along the ranks
    give all conditions.
    """
    got = rows.select(F.explode("ranks").alias("r"), "bad").groupBy("r.c", "r.upto", "r.below").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()
    out: dict[Condition, tuple[int, int]] = {}
    for c, name in enumerate(cuts):
        own = [x for x in got if x["c"] == c]
        for k, v in enumerate(cuts[name]):
            above, below = [x for x in own if x["upto"] > k], [x for x in own if x["below"] <= k]
            out[Condition(name, True, v)] = sum(x["b"] for x in above), sum(x["g"] for x in above)
            out[Condition(name, False, v)] = sum(x["b"] for x in below), sum(x["g"] for x in below)
    return out


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list for rows of (statistics, bad boolean, growing boolean)."""
    spark = labelled.sparkSession
    total = labelled.agg(F.count_if("bad").alias("b"), F.count("*").alias("n")).first()
    if not total["b"] or total["b"] == total["n"]:
        return []
    rules: list[Rule] = []
    left = labelled
    for _ in range(MAX_RULES):
        if not all(counts(left, [()])[0]):
            break
        # cuts follow the rows that are left, so that what is rare at first has its thresholds later
        cuts = thresholds(left)
        ranked, path = stash(left.withColumn("ranks", ranks(cuts)), "ranked")
        grow, prune = ranked.where("growing"), ranked.where("not growing")
        (b0, g0) = counts(grow, [()])[0]
        rule: Rule = ()
        while b0 and g0 and len(rule) < MAX_CONDITIONS:
            gain, best, now = 0.0, None, (b0, g0)
            for atom, (b, g) in tally(grow.where(sql_of(rule)), cuts).items():
                if b and atom not in rule:
                    v = b * (math.log2(b / (b + g)) - math.log2(b0 / (b0 + g0)))
                    if v > gain + 1e-9:
                        gain, best, now = v, atom, (b, g)
            if best is None:
                break
            rule, (b0, g0) = (*rule, best), now
        # the shortest beginning of the rule that is most precise on rows it was not grown on
        heads = [rule[: k + 1] for k in range(len(rule))]
        scored = [((b + 1) / (b + g + 2), b, g, h) for h, (b, g) in zip(heads, counts(prune, heads), strict=True)] if heads else []
        discard(spark, path)
        if not scored:
            break
        worth, covered, wrong, rule = max(scored, key=lambda x: (round(x[0], 3), -len(x[3])))
        if worth < LEAST_WORTH or covered < LEAST_PRECISION * (covered + wrong) or covered < max(2, LEAST_COVER * total["b"] / 3):
            break
        rules.append(rule)
        left = left.where(f"not ({sql_of(rule)})")
    return rules


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Cuts of each statistic: quantiles of the rejected and of the good rows."""
    at = F.array(*[F.lit((k + 0.5) / QUANTILES) for k in range(QUANTILES)])
    found = rows.groupBy("bad").agg(*[F.percentile(F.col(c), at).alias(c) for c in STATISTICS]).collect()
    return {c: sorted({float(v) for row in found for v in row[c]}) for c in STATISTICS}


def ranks(cuts: dict[str, list[float]]) -> Column:
    """Per statistic, how many cuts are at most and how many are below a row's value."""
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    rank = lambda c, test: F.size(F.filter(literal(cuts[c]), lambda x: test(x, F.col(c))))
    return F.array(*[F.struct(F.lit(i).alias("c"), rank(c, lambda x, v: x <= v).alias("upto"), rank(c, lambda x, v: x < v).alias("below")) for i, c in enumerate(cuts)])


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: kept unless a rule rejects."""
    out = "true"
    for r in reversed(rules):
        out = f"CASE WHEN {sql_of(r)} THEN false ELSE {out} END"
    return F.expr(out)


def with_statistics(d: DataFrame) -> DataFrame:
    """d with the named statistics beside its counts; n_words keeps its count."""
    return d.select("*", *[F.expr(e).alias(c) for c, e in STATISTICS.items() if c != "n_words"])


def decision_list(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", bad: str = "quality = 0") -> list[Rule]:
    """Learns from statistics rows that are labelled; ids without a label, or null, teach nothing."""
    y = labels.select(F.col(doc_id).alias("__d"), F.expr(bad).alias("bad")).dropna().dropDuplicates(["__d"])
    n = y.count()
    if n > SAMPLE:
        y = y.where(F.pmod(F.xxhash64("__d", F.lit(5)), F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    y = y.withColumn("growing", F.pmod(F.xxhash64("__d", F.lit(3)), F.lit(3)) > 0)
    # the sample is bounded, and so is what is broadcast
    rows = with_statistics(stats).join(F.broadcast(y), F.col("doc_id") == F.col("__d")).select(*STATISTICS, "bad", "growing")
    rows, path = stash(rows, "labelled")
    rules = learn(rows)
    discard(stats.sparkSession, path)
    return rules


def assess(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """The statistics of every row with base_failed and kept, and the decision list that judged.

    base_failed: under 20 words, or over 30 percent of the words repeated. Null and
    empty texts have zero counts and fail. Rows that repeat an id are judged alike.
    """
    stats, _ = stash(statistics(docs, doc_id, text), "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = decision_list(stats.where(~failed), labels)  # the list judges what the base leaves
    got = with_statistics(stats).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))
    return got, rules


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

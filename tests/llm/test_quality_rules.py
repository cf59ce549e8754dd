import random
import re
from collections import Counter

import quern.llm.quality_rules as m

DOCS = "doc_id long, text string, quality int, n_words string"
LABELS = "doc_id long, quality int, toxic int, text string"


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def texts(r, n):
    out = []
    vocab = [f"{c}{k}" for c in ("ab", "é", "q.", "日本") for k in range(30)]
    for _ in range(n):
        w = r.choices(vocab, k=r.choice([0, 3, 7, 8, 9, 16, 25, 60, 200]))
        if r.random() < 0.4 and len(w) > 8:
            k = r.randrange(len(w) - 8)
            w[r.randrange(len(w)) :] = w[k : k + r.randint(6, 20)] * r.randint(1, 3)
        if r.random() < 0.3:
            w = [x + r.choice(["***", "$", "<|>", "&"]) for x in w]
        out.append("".join(x + r.choice([" ", " ", " ", "\n", "\t ", "\r\n", "\x0b", "\n \n"]) for x in w))
    return out


def test_base_counts(spark):
    r = random.Random(1)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(r, 250))]
    rows += [(900, None, 1, ""), (901, "", 1, ""), (902, "\n \n\t", 1, ""), (903, "a " * 5000, None, None), (904, " \n".join(f"w{i % 7000}" for i in range(21000)), None, None), (None, "x y", 0, "")]
    got = {x.doc_id: x for x in m.statistics(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base(t), i


def test_learned_list(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.25
        w = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(900)) for _ in range(60)]
        if bad:
            w = [x + "***" for x in w] if i % 2 else [x.upper() for x in w]
        rows.append((i, " ".join(w), 1, "x"))
        labels.append((i, int(not bad), 0, ""))
    rows += [(5, rows[5][1], 0, ""), (None, None, 0, ""), (700, "few words", 1, "")]
    got, rules = m.assess(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400] + [(None, 0, 0, ""), (9999, 0, 0, ""), (3, None, None, "")], LABELS))
    assert 1 <= len(rules) <= m.MAX_RULES and all(1 <= len(x) <= m.MAX_CONDITIONS for x in rules)
    out = {x.doc_id: x for x in got.collect()}
    assert sum(out[i].kept == (labels[i][1] == 1) for i in range(400, 600)) >= 196
    assert out[None].base_failed and not out[None].kept and out[700].base_failed and got.count() == len(rows)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    got, rules = m.assess(spark.createDataFrame([(1, "w " * 10 + " ".join(map(str, range(40))), 0, "")], DOCS), none)
    assert rules == [] and [x.kept for x in got.collect()] == [True]
    assert m.assess(spark.createDataFrame([], DOCS), none)[0].collect() == []

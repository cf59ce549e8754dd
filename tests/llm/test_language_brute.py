import math
import random
import re
import unicodedata
from collections import Counter

import quern.llm.language as m
from test_language import PARTS, SCHEMA, data, text


def grams(word):
    seq = "^" + word + "$"
    return [seq[i : i + k] for k in range(1, 5) for i in range(len(seq) - k + 1) if not (k == 1 and seq[i] in "^$")]


def words(t):
    return ["".join(c for c in w if c.isalpha()) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]


def script(word):
    return {unicodedata.name(c).split()[0] for c in word}


def plain(rows, learn):
    langs = sorted({la for i, _, la, _ in rows if i in learn})
    count, letters = {la: Counter() for la in langs}, {la: Counter() for la in langs}
    for i, t, la, _ in rows:
        if i in learn:
            for w in filter(None, words(t)):
                count[la].update(grams(w))
                for s in script(w):
                    letters[la][s] += len(w)

    def scores(w):
        may = [la for la in langs if any(letters[la][s] > m.SCRIPT_SHARE * sum(letters[la].values()) for s in script(w))]
        total = {la: sum(math.log((count[la][g] + 0.5) / (sum(count[la].values()) + 0.5 * m.FEATURES)) for g in grams(w)) / math.sqrt(4 * len(w)) for la in may}
        best = max(total.values(), default=0)
        return [max(total[la] - best, -m.CLIP) if la in total else -m.CLIP if may else 0.0 for la in langs], bool(may)

    def label(t):
        ws = words(t)
        if not any(ws):
            return "und", 0.0
        got = [scores(w) if w else ([0.0] * len(langs), False) for w in ws]
        v, back = got[0][0], []
        for s, _ in got[1:]:
            top = max(range(len(langs)), key=lambda k: v[k])
            back.append([k if v[k] >= v[top] - m.SWITCH else top for k in range(len(langs))])
            v = [max(v[k], v[top] - m.SWITCH) + s[k] for k in range(len(langs))]
        path = [max(range(len(langs)), key=lambda k: v[k])]
        for b in reversed(back):
            path.append(b[path[-1]])
        share = [0] * len(langs)
        for k, w, (_, has) in zip(reversed(path), ws, got, strict=True):
            share[k] += len(w) * has
        k = max(range(len(langs)), key=lambda k: share[k])
        return langs[k], share[k] / sum(map(len, ws))

    return label


def test_training_and_labels_against_plain_computation(spark):
    r, rows = random.Random(4), data(4)
    mixed = [(300 + k, " ".join(text(r, la, r.randint(5, 25)) for la in r.choices(list(PARTS), k=3)) + " 12 ωω --", None, None) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    learn = {x.doc_id for x in docs.where(m.remainder("doc_id") != 2).select("doc_id").collect()}
    label = plain(rows, learn)
    got = {x.doc_id: x for x in m.identify(spark.createDataFrame(rows + mixed, SCHEMA), m.model_of(docs)).collect()}
    close = 0
    for i, t, *_ in rows + mixed:
        lang, score = label(t)
        close += got[i].lang_pred == lang and abs(got[i].score - score) < 0.02
    assert close >= len(rows + mixed) - 2  # features share numbers now and then


def test_a_script_that_no_language_has(spark):
    docs = spark.createDataFrame(data(), SCHEMA)
    model = m.model_of(docs)
    frame = spark.createDataFrame([(1, "ωω ψυχη λογος", None, None), (1, "ωω ψυχη λογος", None, None), (2, "the ωω", None, None)], SCHEMA)
    got = sorted((x.doc_id, x.lang_pred, round(x.score, 3)) for x in m.identify(frame, model).collect())
    assert got == [(1, "aa", 0.0), (1, "aa", 0.0), (2, "aa", 0.6)]
    assert [x.doc_id for x in m.keep_identified(frame, model).collect()] == [2]


def test_languages_that_tie_fall_by_name():
    model = m.Model(["aa", "bb"], m.np.zeros((m.FEATURES + 1, 2), m.np.float32), m.np.ones((len(m.NAMES) + 1, 2), bool))
    assert m.judge(["some words", None, ""], model) == [("aa", 1.0, [("aa", 0, 2)]), ("und", 0.0, []), ("und", 0.0, [])]

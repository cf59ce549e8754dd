import random

import numpy as np
import pyarrow as pa

from quern.llm import common as m


def test_word_hashes_follow_the_words():
    r = random.Random(2)
    texts = ["", None, " ", "A b", "a B", "a\x0bb\x0cc\r\n\td", "éa é a", "x" * 5000, "Ä ä", "\xa0 \x1c \x1cq", "end", "start end"]
    texts += [" ".join(r.choices(["ab", "ba", "abc", "Zz", "é", "　"], k=r.randint(0, 300))) + r.choice(["", " ", "\n"]) for _ in range(200)]
    for go in (64, 1 << 18):
        m._GO, was = go, m._GO
        for cut in (0, 3):
            batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]).slice(cut)
            got = list(m.batch_hashes(batch, "t"))
            word: dict[int, bytes] = {}
            for t, h in zip(texts[cut:], got, strict=True):
                b = (t or "").encode()
                w = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in b).split()
                assert len(w) == len(h) and np.array_equal(h, m.text_hashes(b))
                assert all(word.setdefault(int(x), y) == y for x, y in zip(h, w, strict=True))
            assert len(word) == len(set(word.values()))
        m._GO = was


def test_word_hashes_tell_all_words_apart():
    r = random.Random(8)
    words = {"".join(r.choices("abcdeé", k=r.randint(1, 30))) for _ in range(100_000)}
    words |= {"x" * 20 + a + b + "y" * 10 for a in "abcdefghij" for b in "klmnopqrst"} | {"x" * 20 + b + a + "y" * 10 for a in "abcdefghij" for b in "klmnopqrst"}
    h = m.text_hashes(" ".join(sorted(words)).encode())
    assert len(np.unique(h)) == len(words)
    for bits in (16, 48):  # any part of the hash is spread evenly
        n = np.bincount((h >> np.uint64(bits)).astype(np.int64) & 255, minlength=256)
        assert n.min() > 0.7 * len(words) / 256
    runs = m.window_hashes(h, 5)
    assert len(np.unique(runs)) == len(runs)
    assert np.array_equal(m._powers_to(4)[:3], np.array([1, m._BASE, m._BASE * m._BASE % 2**64], np.uint64))


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(150)] + [(900, 900), (None, 3), (5, None), (1, 0)]
    got, _ = m.components(spark.createDataFrame(edges, "a long, b long"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in list(root))
    assert m.components(spark.createDataFrame([], "a long, b long"))[0].collect() == []

import collections
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from lodestone.llm import lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall((text or "").encode().lower()) + [None]


def brute(rows, mu):
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c, pairs, n_train = collections.Counter(), collections.Counter(), 0
    for (_, t), h in zip(rows, held):
        if not h:
            n_train += 1
            w = tokens(t)
            c.update(w)
            pairs.update(zip(["start", *w], w))
    total, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (total + 0.5 * (v + 1))
    out = []
    for (d, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10(p1(x)) for x in w)
        full = sum(math.log10((pairs[a, x] + mu * p1(x)) / ((n_train if a == "start" else c[a]) + mu)) for a, x in zip(["start", *w], w))
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), total, base, full))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("The the of and to a b C c d\te x1 x2 é".split(" "), k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "rare " * 30000), (504, "A" * 9000), (505, "same text"), (505, "same text"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(4)
    out = lm.score_held_out(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, expected = sorted(map(tuple, out), key=key), sorted(brute(rows, 500.0), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for g, e in zip(got, expected):
        assert abs(g[5] - e[5]) < 1e-6 * max(1, abs(e[5]))
        assert abs(g[6] - e[6]) < 0.02 * max(1, abs(e[6]))
    assert lm.score_held_out(docs.limit(0)).collect() == []
    none = lm.score(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in none)


def test_frequent_contexts_are_dealt_by_word(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=80))) for i in range(40)] + [(99, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sorted(map(tuple, lm.score_held_out(docs).collect()))
    monkeypatch.setattr(lm, "SPLIT_COUNT", 7)
    split = sorted(map(tuple, lm.score_held_out(docs).collect()))
    assert plain == split and [r[:5] for r in plain] == [r[:5] for r in sorted(brute(rows, 500.0))]

import random
import re

import numpy as np
import pytest

from lodestone.llm import shared, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts, window):
    docs = [WORD.findall((t or "").encode()) for t in texts]
    count = {}
    for d in docs:
        for i in range(len(d) - window + 1):
            key = tuple(d[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if count[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out


def corpus():
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [None, "", " \n ", "short text", passage, "é " + passage + "\n\ttail", "x " * 80, passage.replace("p7 ", "q ")]
    for _ in range(120):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()[: rng.randint(20, 50)]
        if rng.random() < 0.2:
            words = words + words
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts + texts[8:12]


@pytest.mark.parametrize("window", [5, 35])
def test_against_brute_force(spark, window):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    out = {r.doc_id: r for r in substring.dedup(docs.drop("kept"), window).collect()}
    for i, expected in enumerate(brute(texts, window)):
        r = out[i]
        assert (r.n_words, r.n_removed, r.kept) == expected
        assert sum(e - s for s, e in r.repeats) == r.n_removed
    assert substring.dedup(docs.limit(0), window).collect() == []


def test_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    docs = spark.createDataFrame([(1, long, "en"), (1, long, "en"), (None, "z " + " ".join(long.split()[100:140]), None), (2, "w1 w2", "x")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in substring.dedup(docs, carry=("doc_id", "lang")).collect()}
    assert (out[1].n_removed, out[1].kept, out[1].lang) == (60000, "", "en")
    assert (out[None].n_removed, out[None].kept) == (40, "z")
    assert out[2].n_removed == 0


def test_word_helpers():
    import pyarrow as pa

    texts = ["", "a\tb  É", " ", "abc", "x" * 5000, "end "]
    data, offsets = shared.text_bytes(pa.array(texts))
    start, end, words = shared.word_spans(data, offsets)
    assert words.tolist() == [len(WORD.findall(t.encode())) for t in texts]
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end)] == [w.decode() for t in texts for w in WORD.findall(t.encode())]
    hashes = shared.word_hashes(data, start, end, lower=True, chunk=7)
    again, o2 = shared.text_bytes(pa.array(["A b É ABC " + "X" * 5000 + " END"]))
    assert hashes.tolist() == shared.word_hashes(again, *shared.word_spans(again, o2)[:2], lower=True).tolist()
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 999).astype(np.uint64))
    for k in (keys, keys[:1], keys[:0], np.array([5, 5, 2**64 - 1], np.uint64)):
        assert shared.unpack_sorted(shared.pack_sorted(k)).tolist() == k.tolist()


def test_deep_nodes_are_the_runs_that_occur_twice():
    rng = np.random.default_rng(3)
    for kinds, n, depth in ((2, 200, 5), (3, 3000, 9), (1 << 40, 50, 2), (1, 100, 35), (5, 0, 3)):
        number = rng.integers(0, kinds, n + depth)
        number[n // 2 :] = number[: len(number) - n // 2] if kinds > 3 else number[n // 2 :]
        at = rng.permutation(n)[: n - n // 5]
        node = substring.deep_nodes(number, at, depth)
        runs = [tuple(number[i : i + depth].tolist()) for i in at]
        same = {}
        for run, x in zip(runs, node.tolist(), strict=True):
            assert (x >= 0) == (runs.count(run) > 1)
            assert x < 0 or same.setdefault(x, run) == run
        assert len(set(same.values())) == len(same)


def test_least_ahead():
    values = np.random.default_rng(4).integers(0, 4, 90).astype(np.uint64)
    for span in (1, 2, 7, 28, 90, 91):
        expected = [i + int(np.argmin(values[i : i + span])) for i in range(len(values) - span + 1)]
        assert substring.least_ahead(values, span).tolist() == expected


@pytest.mark.parametrize("hot_suffixes", [-(1 << 40), 20])
def test_lengthened_prefixes_give_the_same_rows(spark, hot_suffixes):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for window in (5, 35):
        out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs, window, hot_suffixes=hot_suffixes).collect()}
        assert [out[i] for i in range(len(texts))] == brute(texts, window)

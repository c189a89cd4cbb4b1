import itertools
import random
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lodestone.llm import packing

TOKENIZER = P.path("byte_bpe_50k.json")


def optimum(items, capacity):
    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        head, rest = left[0], left[1:]
        out = [99]

        def fill(i, room, kept):
            if i == len(rest):
                out[0] = min(out[0], 1 + best(tuple(kept)))
                return
            if rest[i] <= room:
                fill(i + 1, room - rest[i], kept)
            fill(i + 1, room, [*kept, rest[i]])

        fill(0, capacity - head, [])
        return out[0]

    return best(tuple(sorted(items, reverse=True)))


def check_plan(histogram, capacity, patterns):
    used = {}
    for items, bins in patterns:
        assert bins > 0 and sum(k * n for k, n in items) <= capacity
        for k, n in items:
            used[k] = used.get(k, 0) + n * bins
    assert used == {k: n for k, n in histogram.items() if n}


def test_plan_against_brute_force():
    random.seed(3)
    worse = 0
    for _ in range(150):
        items = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        histogram = {k: items.count(k) for k in items}
        patterns = packing.plan(histogram, 20)
        check_plan(histogram, 20, patterns)
        worse += sum(b for _, b in patterns) - optimum(items, 20)
    assert worse == 0


def test_completion_beats_best_fit():
    random.seed(5)
    gain = 0
    for _ in range(60):
        histogram = {}
        for _ in range(40):
            k = random.randint(15, 60)
            histogram[k] = histogram.get(k, 0) + 1
        first = packing.best_fit(histogram, 100)
        last = packing.plan(histogram, 100)
        check_plan(histogram, 100, first)
        check_plan(histogram, 100, last)
        gain += sum(b for _, b in first) - sum(b for _, b in last)
        assert sum(b for _, b in last) <= sum(b for _, b in first)
    assert gain > 0


def test_dominance():
    assert packing.dominated((3, 4), (7,)) and not packing.dominated((3, 5), (7,))
    assert packing.dominated((2, 3, 5), (5, 5)) and not packing.dominated((4, 4, 4), (6, 6))


def test_packed(spark):
    random.seed(2)
    words = ["alpha", "beta", "  gamma", "\n", "été", "日本", "<|endoftext|>"]
    rows = [(i, " ".join(random.choices(words, k=random.choice([0, 1, 5, 60, 300, 2000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as part").repartition(3)
    out = packing.packed(docs, TOKENIZER, P.PATTERN, 256).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    expected = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            expected.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    histogram = {}
    for r in out:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    assert len(bins) == sum(b for _, b in packing.plan(histogram, 256)) <= sum(b for _, b in packing.best_fit(histogram, 256))
    assert packing.packed(docs.limit(0), TOKENIZER, P.PATTERN).collect() == []


def test_fillings_of_many_pieces():
    lengths = [332, 707, 416, 483, 110, 565, 259, 479, 108, 637]
    histogram = dict.fromkeys(lengths, 1)
    assert sum(b for _, b in packing.best_fit(histogram, 2048)) == 3
    found = packing.plan(histogram, 2048)
    assert sum(b for _, b in found) == 2 and all(len(items) == 5 for items, _ in found)


def test_fillings_against_all_sets():
    """Every set of pieces that fits is a filling or dominated by one; none comes twice; sums never rise."""
    rng = random.Random(6)
    for _ in range(60):
        pool = [rng.randint(2, 12) for _ in range(rng.randint(1, 7))]
        room = rng.randint(1, 30)
        counts = {k: pool.count(k) for k in pool}
        got = list(packing.fillings(counts, room))
        sums = [sum(x) for x in got]
        assert len(set(got)) == len(got) and sums == sorted(sums, reverse=True) and sums[0] <= room
        every = {tuple(sorted(c, reverse=True)) for n in range(len(pool) + 1) for c in itertools.combinations(pool, n) if sum(c) <= room}
        assert set(got) <= every and all(any(packing.dominated(x, y) for y in got) for x in every)


def test_search_beats_best_fit():
    """Instances that fill their bins without waste, so that best fit misses the bound: the search must win some."""
    rng, won = random.Random(9), 0
    for _ in range(20):
        histogram: dict[int, int] = {}
        for _ in range(6):
            cuts = sorted(rng.sample(range(5, 95), 4))
            for a, z in itertools.pairwise([0, *cuts, 100]):
                histogram[z - a] = histogram.get(z - a, 0) + 1
        first, best = (sum(b for _, b in x) for x in (packing.best_fit(histogram, 100), packing.plan(histogram, 100)))
        assert 6 == packing.lower_bound(histogram, 100) <= best <= first
        won += first > best
    assert won > 0


def test_search_ends():
    """Nineteen lengths, seven pieces each: many sums, of which nearly all waste more than a better packing may."""
    began = time.time()
    found = packing.plan({k: 7 for k in range(50, 951, 50)}, 2048)
    assert time.time() - began < 20 and sum(bins for _, bins in found) in (33, 34)
    used = Counter()
    for items, bins in found:
        assert sum(k * n for k, n in items) <= 2048
        for k, n in items:
            used[k] += n * bins
    assert used == {k: 7 for k in range(50, 951, 50)}
    asked = []
    list(packing.fillings({k: 7 for k in range(50, 951, 50)}, 2048, go_on=lambda: len(asked) < 50 and not asked.append(1)))
    assert len(asked) == 50

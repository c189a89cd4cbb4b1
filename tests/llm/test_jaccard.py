import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import jaccard
from lodestone.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out


def corpus(rng, n, most):
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randint(0, len(words))
                words[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 50)}"] * rng.randint(0, 1)
        else:
            words = [rng.choice("the of and to in a is it".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, most))]
        texts.append(" ".join(words))
    return texts


def compare(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, a int").repartition(parts)
    got = sorted((tuple(r)[:3] for r in jaccard.similar(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_pigeonhole_covers_every_linked_pair():
    rng = np.random.default_rng(3)
    t = Fraction(4, 5)
    for _ in range(1500):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 90)).astype(np.uint64))
        drop, add = rng.integers(0, len(x) // 5 + 2, 2)
        y = np.unique(np.append(rng.permutation(x)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < 80 * (len(x) + len(y) - common):
            continue
        (key, member, up), sure = jaccard.keys(np.array([len(x), len(y)]), np.concatenate([x, y]), t)
        sent = [{int(k): int(u) for k, u in zip(key[member == i], up[member == i], strict=True)} for i in (0, 1)]
        schemes = [(sent[0][k], sent[1][k]) for k in sent[0] if k in sent[1] and sent[0][k] + sent[1][k] < 2]
        assert any(schemes.count((a, b)) >= max(sure[a, 0], sure[b, 1]) >= 1 for a, b in schemes), (len(x), len(y), common)


def test_small_sets_use_neighbourhoods():
    t = Fraction(4, 5)
    worth = [jaccard.scheme(b, t)[3] for b in range(25)]
    assert 2 in worth and 1 in worth


@pytest.mark.parametrize("seed,n,most", [(1, 150, 40), (2, 120, 200), (3, 200, 9)])
def test_against_brute_force(spark, seed, n, most):
    rng = random.Random(seed)
    compare(spark, list(enumerate(corpus(rng, n, most))))


def test_edges(spark, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randint(0, 999)}" for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, base), (7, base), (None, base.upper()), (8, base + " tail"), (9, "É x y z w"), (10, "é x y z w")]
    rows += [(20 + i, " ".join(base.split()[: 60 - i])) for i in range(14)]
    rows += [(100 + i, " ".join(f"v{j + i}" for j in range(64))) for i in range(0, 60, 2)]
    rows += [(300, " ".join(f"l{i}" for i in range(40000))), (301, " ".join(f"l{i}" for i in range(39000)))]
    monkeypatch.setattr(jaccard, "SMALL", 2)
    compare(spark, rows)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    compare(spark, rows)
    docs = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert jaccard.similar(docs.limit(0)).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (7, 6)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    y = x[40:]
    f0, f1, s = jaccard.fingerprints(np.array([len(x), len(y)]), np.concatenate([x, y]))
    assert sum(int(v & (2**64 - 1)).bit_count() for v in (s[0] ^ s[1]).astype(object)) <= 40 and f0[0] != f0[1]
    assert jaccard.shingle_sets(pa.array(["a b", "", "A B", "a b c d e f"]))[0].tolist() == [1, 0, 1, 2]


def links(rows):
    """The number of other sets that each row's set is linked with."""
    different = list({frozenset(shingles(t)) for _, t in rows})
    near = lambda x, y: x != y and 100 * len(x & y) >= 80 * len(x | y)
    count = {x: sum(near(x, y) for y in different) for x in different}
    return [(d, count[frozenset(shingles(t))]) for d, t in rows]


@pytest.mark.parametrize("block", [1024, 5])
def test_links_of_many_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(100)]
    texts = [" ".join([*base[:-1], f"last{i}"]) for i in range(20)]  # all linked with each other
    slid = [f"s{i}" for i in range(130)]
    texts += [" ".join(slid[i : i + 100]) for i in range(0, 30, 2)]  # a chain: only neighbours are linked
    three = [f"t{i}" for i in range(100)]
    texts += [" ".join(three)] * 40 + [" ".join([*three[:-1], "x"]), " ".join([*three[:-1], "y"])]
    texts += [" ".join([*(f"p{i}" for i in range(60)), x]) for x in "ab"] + ["alone " * 9, "", "one"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((r.doc_id, r.n_links) for r in jaccard.similar(docs).collect()) == links(rows)


def test_common_passages(spark, monkeypatch):
    """Most segments lie in a passage that all documents share: sets are saturated without being similar."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(passage + [f"o{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 12, 16, 24, 40, 80]))]) for _ in range(60)]
    texts += [" ".join(x.split()[:-1]) for x in texts[:20]]
    rows = list(enumerate(texts))
    compare(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links) for r in jaccard.similar(docs).collect()) == links(rows)


def test_saturated_sets_are_not_paired_by_rows(spark, monkeypatch):
    """Heavily edited copies of one passage: none is linked by its hub, and their pairs are compared in tiles, not written as rows."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    seen, verify = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda pairs, *more: seen.append(pairs.count()) or verify(pairs, *more))
    rng = random.Random(6)
    counts = {}
    for n in (60, 180):
        seen.clear()
        passage = [f"p{i}" for i in range(90)]
        texts = [" ".join(passage + [f"o{rng.randint(0, 10**6)}" for _ in range(rng.choice([16, 24, 40]))]) for _ in range(n)]
        rows = list(enumerate([*texts, *(" ".join(x.split()[:-1]) for x in texts[:20])]))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = jaccard.similar(docs).collect()
        assert sorted((r.doc_id, r.n_links) for r in out) == links(rows)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)
        counts[n] = sum(seen)
    assert counts[180] < 4 * counts[60]


def test_links_join_labels():
    label = np.array([7, 7, 3, 9, 20])
    assert [x.tolist() for x in jaccard._rooted(label, label, np.array([0, 2, 0]), np.array([2, 3, 1]))] == [[7, 9], [3, 3]]


def test_representatives_are_rows(spark, monkeypatch):
    """Ids that repeat or are null: rows are chosen, not ids. Other columns stay, whatever their names."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(5, base, 1), (5, other, 2), (7, base + " tail", 3), (None, base, 4), (None, other + " x", 5), (None, "alone", 6), (9, None, 7), (9, "", 8), (4, "two words", 9), (4, "two words", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    for few in (jaccard.BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
        out = jaccard.representatives(docs)
        assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == [1, 2, 6, 7, 8, 9]

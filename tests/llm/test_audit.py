import itertools
import random
import re

from lodestone.llm import audit

DOCS = "doc_id long, text string, lang string, part int, mask string, print string"
LABELS = "doc_id long, quality int, toxic int, n int"


def brute(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    flags = {}
    for i, q, t in labels:
        good, toxic = flags.get(i, (False, False))
        flags[i] = (good or q == 1, toxic or t == 1)
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = word.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, *(flags.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order):
                here = [r for r in alive if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                alive = [r for r in alive if f not in r[1]]
                gone += here
                removed_by[f] += len(here)
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step + 1] = [len(alive), len(here), redundant, unique, sum(r[2] for r in here), sum(r[3] for r in here), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = removed_by[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def documents(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "ß", "e%", "zeta"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([3, 7, 307])], k=rng.choice([1, 150, 230, 400]))) for _ in range(n // 2)]
    texts += ["", None, " \t\n", "A" * 50, "x " * 5000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]
    rows += [(None, texts[0], "en"), (None, texts[0], None), (3, texts[1], "en"), (3, texts[1], "en"), (-5, texts[1], "fr")]
    rows += [(1000 + i, "the same again and again", "en" if i % 3 else "de") for i in range(n)]
    labels = [(rng.randrange(2 * n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1), (1003, 1, 0), (1003, 0, 1)]
    return rows, labels


def test_audit_against_brute_force(spark):
    docs, labels = documents(1, 120)
    tables = spark.createDataFrame([(*d, 1, "m", "p") for d in docs], DOCS).repartition(6), spark.createDataFrame([(*x, 1) for x in labels], LABELS)
    want = brute(docs, labels)
    assert result(audit.audited(*tables)) == want
    assert len(want) == 600 * 4


def test_copies_over_many_tasks(spark):
    """Ranges of a few rows each, so that a group of copies begins and ends anywhere in them."""
    docs, labels = documents(2, 60)
    docs += [(2000 + i // 3, "copies whose ids repeat", "en") for i in range(90)]
    tables = spark.createDataFrame([(*d, 1, "m", "p") for d in docs], DOCS), spark.createDataFrame([(*x, 1) for x in labels], LABELS)
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert audit.compared(tables[0]).where("kind = 2").count() > 10
        assert result(audit.audited(*tables)) == brute(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_colliding_fingerprints():
    """Runs of different texts with one fingerprint are apart."""
    a, b = audit.Run(1, "x"), audit.Run(1, "y")
    assert [a.fails(1, "", 0, False), a.fails(1, "", 0, False), a.fails(2, "", 0, False), b.fails(2, "", 0, True), b.fails(3, "", 0, True)] == [False, False, True, None, True]
    assert b.open == {("", 0): 1} and b.least == 2


def test_empty_table(spark):
    assert audit.audited(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []

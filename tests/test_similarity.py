import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import terms as T
from lodestone.operators import similarity as S

SCHEMA = "tab_id long, item long, seq long, url string, mime_type string, width double, height double, bytes double, path array<struct<tag:string,classes:array<string>>>, in_group boolean, depth int"


def node(tag, *classes):
    return (tag, list(classes))


GRID = [node("img", "grid-thumb"), node("a"), node("li", "grid-item"), node("ul", "photo-grid"), node("main", "gallery"), node("body")]
HERO = [node("img", "hero-image"), node("section", "hero"), node("main", "gallery"), node("body")]
SLIDE = [node("img", "slide"), node("div", "carousel-item"), node("div", "carousel"), node("main", "gallery"), node("body")]


def items(spark, rows):
    out = []
    for i, r in enumerate(rows):
        r = {"url": "", "mime": "", "w": 0.0, "h": 0.0, "path": None, "group": False, "depth": -1, "bytes": 0.0, "tab": 0} | r
        out.append((r["tab"], i, i, r["url"], r["mime"], float(r["w"]), float(r["h"]), float(r["bytes"]), r["path"], r["group"], r["depth"]))
    return S.with_features(spark.createDataFrame(out, SCHEMA), path="path", in_group="in_group", depth="depth")


def explained(spark, a, b):
    df = items(spark, [a, b])
    both = df.where("item = 0").select(F.col("f").alias("a")).crossJoin(df.where("item = 1").select(F.col("f").alias("b")))
    return both.select(T.explain(F.col("a"), F.col("b")).alias("t")).first().t


def grid(i):
    return {"url": f"https://cdn.example.com/gallery/photo-{i}.jpg", "w": 400, "h": 300, "path": GRID, "group": True, "depth": 2, "bytes": 10}


def test_known_scores(spark):
    assert round(explained(spark, {}, {}).total, 4) == 0.225
    thumb = {"url": "https://example.com/wp-content/uploads/2024/01/p-1-150x150.jpg", "w": 150, "h": 150}
    full = {"url": "https://example.com/wp-content/uploads/2024/01/p-1.jpg", "w": 2400, "h": 1600}
    t = explained(spark, thumb, full)
    assert t.url == 0.75 and round(t.total, 4) == 0.6548
    shards = [{"url": f"https://cdn.example.com/{s}/{h}/photo.jpg", "w": 1080, "h": 1080} for s, h in ((1, "aaaaaaaa"), (22, "0123abcd"))]
    assert explained(spark, *shards).url == 1.0
    carousel = {"url": "https://cdn.example.com/slides/s-1.jpg", "w": 1200, "h": 800, "path": SLIDE, "group": True, "depth": 1}
    assert explained(spark, carousel, grid(1)).structure == 0.0
    assert explained(spark, grid(1), grid(2)).structure == 1.0
    net = {"url": "https://cdn.example.com/gallery/photo-9.jpg"}
    assert round(explained(spark, grid(1), net).total, 4) == 0.775
    assert explained(spark, {"url": "https://a/x.jpg", "mime": "image/jpeg"}, {"url": "https://a/y.jpg"}).type == 0.6
    assert explained(spark, {"url": "https://www.a.com/x"}, {"url": "https://m.a.com/y"}).host == 1.0
    assert explained(spark, {"url": "https://i.a.co.uk/x"}, {"url": "https://j.a.co.uk/y"}).host == 0.7


def test_classes(spark):
    names = ["css-1ab2c", "sc-aBcDe", "is-active", "nav-selected", "photo-grid", "Button_a1B2c3D4", "gallery", "x9f8e7d6c"]
    df = spark.createDataFrame([(names,)], "c array<string>")
    assert df.select(T.strip_dynamic_classes(F.col("c"))).first()[0] == ["gallery", "photo-grid"]
    counted = spark.createDataFrame([(["xKqZw9Tr", "grid-thumb"], {"xKqZw9Tr": 1, "grid-thumb": 12})], "c array<string>, n map<string,int>")
    assert counted.select(T.strip_dynamic_classes(F.col("c"), F.col("n"))).first()[0] == ["grid-thumb"]
    entropy = spark.createDataFrame([("abc",), ("aaaa",), ("xK9q",)], "t string").select(T.class_entropy(F.col("t"))).collect()
    assert entropy[0][0] == 0 and entropy[1][0] == 0 and round(entropy[2][0], 2) == 3.9


def mixed(spark):
    rows = [grid(i) for i in range(6)] + [{"url": "https://cdn.example.com/hero/big.jpg", "w": 1600, "h": 900, "path": HERO}]
    rows += [{"url": f"https://cdn.example.com/gallery/photo-{i}.jpg"} for i in range(10, 13)]
    rows += [{"url": f"https://img{i}.other.net/a/b{i}.jpg", "w": 400, "h": 300, "path": GRID} for i in range(3)]
    rows += [{"url": f"https://cdn.example.com/i/icon{i}.png", "w": 16, "h": 16} for i in range(3)] + [{"url": "rel"}, {"url": "data:image/png;base64,AA"}, {"url": "https://x.com/v.mp4", "tab": 1}]
    return items(spark, rows)


@pytest.mark.parametrize("threshold", [0.3, 0.44, 0.45, 0.5, 0.56, 0.6, 0.62, 0.7, 0.75, 0.8])
def test_blocking_equals_brute_force(spark, threshold):
    df = mixed(spark)
    got = {(r.a, r.b, round(r.total, 9)) for r in S.pairs(df, threshold).collect()}
    l, r = df.alias("l"), df.alias("r")
    every = l.join(r, (F.col("l.tab_id") == F.col("r.tab_id")) & (F.col("l.seq") < F.col("r.seq"))).select(F.col("l.item").alias("x"), F.col("r.item").alias("y"), T.score(F.col("l.f"), F.col("r.f")).alias("s"))
    assert got == {(v.x, v.y, round(v.s, 9)) for v in every.collect() if v.s >= threshold}


def test_terms_are_bounded_and_symmetric(spark):
    df = mixed(spark)
    both = df.select(F.col("f").alias("a")).crossJoin(df.select(F.col("f").alias("b"))).select(T.explain(F.col("a"), F.col("b")).alias("x"), T.explain(F.col("b"), F.col("a")).alias("y")).collect()
    for v in both:
        assert tuple(v.x) == tuple(v.y) and all(0 <= t <= 1 for t in v.x)
        assert abs(sum(K.WEIGHTS[n] * v.x[n] for n in K.WEIGHTS) - v.x.total) < 1e-12


def test_cluster_and_describe(spark):
    df = mixed(spark)
    out = S.cluster(df).collect()
    links = {(r.a, r.b) for r in S.pairs(df).collect()}
    root = {r.item: r.item for r in out}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    by = {}
    for r in out:
        by.setdefault((r.tab_id, r.cluster_id), set()).add(r.item)
    assert sorted(map(sorted, by.values())) == sorted(sorted(i for i in root if root[i] == x) for x in set(root.values()))
    sizes = [len(by[k]) for k in sorted(by) if k[0] == 0]
    assert sizes == sorted(sizes, reverse=True) and by[0, 0] >= set(range(6))
    limited = S.cluster(df, limit=5).where("cluster_id = -1")
    assert limited.count() == df.where("tab_id = 0").count() - 5
    label = S.describe(items(spark, [grid(i) for i in range(3)]).withColumn("cluster_id", F.lit(0))).first()
    assert label.label == "3 images · 400x300 · cdn.example.com/gallery/photo-#.jpg" and label.bytes == 30


def test_selection(spark):
    df = mixed(spark)
    seeds = df.where("item in (0)")
    at = {t: {r.item for r in S.select_similar(seeds, df, t).collect()} for t in (0.0, 0.45, 0.62, 0.8)}
    assert at[0.0] == {r.item for r in df.where("tab_id = 0").collect()}
    assert all(at[a] >= at[b] for a, b in itertools.pairwise((0.0, 0.45, 0.62, 0.8)))
    assert S.select_similar(seeds, df).first().score == 1.0
    assert S.proposal(seeds, df).count() == 0
    two = df.where("item in (0, 1)")
    assert {r.item for r in S.proposal(two, df).collect()} == {r.item for r in S.select_similar(two, df).collect()} - {0, 1}
    assert S.proposal(two, df, refused=True).count() == 0


def test_seeds_and_growth(spark):
    df = mixed(spark).withColumns({"element_id": F.concat(F.lit("m"), F.col("item").cast("string")), "normalized_url": F.col("url"), "id": F.col("item").cast("string")})
    one = spark.createDataFrame([(0, "m0")], "tab_id long, element_id string")
    found = {r.item for r in S.find_similar(df, one).collect()}
    assert found == {r.item for r in S.select_similar(df.where("item = 0"), df).collect()} - {0}
    wanted = spark.createDataFrame([(0, "/gallery/photo-3.jpg", "https://cdn.example.com/x"), (0, "https://new.com/a.jpg", "https://new.com/")], "tab_id long, src string, page_url string")
    got = {r.src: (r.url, r.known) for r in S.seeds_for(df, wanted).collect()}
    assert got == {"/gallery/photo-3.jpg": ("https://cdn.example.com/gallery/photo-3.jpg", True), "https://new.com/a.jpg": ("https://new.com/a.jpg", False)}
    assert {r.item for r in S.grown(df.where("item = 0"), df).collect()} == found | {0}
    assert S.still_there(spark.createDataFrame([(0, "1"), (0, "99")], "tab_id long, id string"), df).count() == 1


def scattered(spark, n, seed):
    """Items of many hosts with and without paths, dimensions, types and tokens."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(12)] + ["media"] * 6
    rows = []
    for i in range(n):
        host = rng.choice(["cdn.a.com", "img.a.com", "b.org", "c.net", "d.io", "e.co.uk"])
        name = "/".join(rng.choices(words, k=rng.randint(1, 6)))
        depth = rng.choice([0, 0, 1, 3, 6, 18])
        path = [node(rng.choice(["div", "li", "ul"]), *rng.choices(["x", "y"], k=1)) for _ in range(depth)][: max(0, depth - 2)] + [node("main"), node("body")] if depth else None
        rows.append({
            "url": rng.choice([f"https://{host}/{name}.{rng.choice(['jpg', 'png', 'mp4'])}"] * 9 + [f"rel{i}"]), "w": rng.choice([0, 100, 400, 1200]), "h": rng.choice([0, 100, 300, 1200]),
            "path": path, "group": rng.random() < 0.4, "depth": rng.choice([-1, 0, 2]), "tab": i % 2,
        })
    return items(spark, rows)


@pytest.mark.parametrize("threshold", [0.45, 0.52, 0.58])
def test_loose_pairs_equal_all_pairs(spark, threshold):
    df = scattered(spark, 160, 4).persist()
    every = {(r.a, r.b): round(r.total, 9) for r in S.pairs(df, 0.0).collect() if r.total >= threshold}
    assert {(r.a, r.b): round(r.total, 9) for r in S.pairs(df, threshold).collect()} == every and len(every) > 30
    found = S.candidates(df, threshold).select("l.item", F.col("r.item").alias("other")).collect()
    assert len(found) == len(set(map(tuple, found))) < 2 * 80 * 79 // 2


def test_forest_and_cuts(spark):
    df = scattered(spark, 120, 5).persist()
    links = S.pairs(df, K.PRESETS["loose"]).select("tab_id", "a_seq", "b_seq", "total").persist()
    forest = S.spanning_forest(links)
    edges = forest.collect()
    nodes = df.select("tab_id", "seq")
    thresholds = [K.PRESETS[x] for x in ("loose", "balanced", "strict")]
    got = {(r.tab_id, r.cut, r.seq): r.root for r in S.cuts(nodes, forest, thresholds).collect()}
    assert len(got) == 3 * 120
    for cut in thresholds:
        want = {(r.tab_id, r.seq): r.root for r in S.components(nodes, links.where(F.col("total") >= cut)).collect()}
        assert {(t, s): r for (t, c, s), r in got.items() if c == cut} == want
    trees = len(set((t, r) for (t, c, s), r in got.items() if c == thresholds[0]))
    assert len(edges) == 120 - trees and S.spanning_forest(links.limit(0)).collect() == []

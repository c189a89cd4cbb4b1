import itertools
import random

import pytest

from lodestone import storage
from lodestone.operators import index
from lodestone.operators import similarity as S
from lodestone.plans import registry
from lodestone.sources import dom
from tests.test_similarity import GRID, items


def mixed(spark, n=90):
    """Items whose hosts, folders, names, extensions, types, sizes and paths agree in part, some of them several times."""
    dice = random.Random(4)
    pick = lambda *xs: dice.choice(xs)
    rows = []
    for _ in range(n):
        host, folder, name, ext = pick("cdn.a.com", "www.a.com", "img.a.com", "m.b.net"), pick("/x", "/x/y", ""), pick("red-1", "red-2", "blue-car", "zed"), pick(".jpg", ".jpg", ".jpeg", ".png", "")
        row = {"url": f"https://{host}{folder}/{name}{ext}", "tab": pick(0, 1), "w": pick(0, 400, 400, 640), "h": 300, "mime": pick("", "", "image/jpeg")}
        rows.append(row | ({"path": GRID} if dice.random() < 0.3 else {}))
    return items(spark, rows + [{"url": "rel", "tab": 0}, {"url": "rel", "tab": 0}, {"url": "data:image/png;base64,AA", "tab": 0}, {"url": "data:image/png;base64,AB", "tab": 0}])


@pytest.mark.parametrize("threshold", [0.45, 0.618, 0.62, 0.8])
def test_totals_by_shapes_are_those_of_all_pairs(spark, threshold):
    df = mixed(spark)
    want = {}
    for r in S.pairs(df, 0.0).collect():
        if r.total >= threshold:
            n, total = want.get(r.tab_id, (0, 0.0))
            want[r.tab_id] = (n + 1, total + r.total)
    got = {r.tab_id: (r.pairs, round(r.total, 6)) for r in S.pair_totals(df, threshold).collect()}
    assert got == {t: (n, round(x, 6)) for t, (n, x) in want.items()}


def test_items_of_one_host_are_not_paired(spark, monkeypatch):
    """Names differ, so each item is a class; the old way made all 44,850 pairs to count them."""
    names = ["-".join(x) for x in itertools.product("abcdefghij", "klmnopqrst", "uvw")]
    df = items(spark, [{"url": f"https://cdn.a.com/m/{x}.jpg", "tab": 0, "w": 40 + i % 3, "h": 30} for i, x in enumerate(names)])
    made, scored = [], S.scored
    monkeypatch.setattr(S, "scored", lambda found, *more: made.append(found.count()) or scored(found, *more))
    n = len(names)
    row = S.pair_totals(df).first()
    assert sum(made) == 0 and row.pairs == n * (n - 1) // 2
    assert S.shaped_links(S.classes(df)[0], 0.62).count() <= 6


def test_long_pages_are_scanned_to_their_end():
    """All elements count, in linear time: siblings are compared once per parent."""
    n = 20_000
    page = "<body>" + "<p class='cell'></p>" * n + "<div class='cell' data-src='/last.jpg'></div>" + "<b data-x='/b.jpg'></b>" * n
    rows = dom.scan(page)
    assert len(rows) == n + 1 and rows[0]["url"] == "/last.jpg" and rows[0]["class_counts"] == {"cell": n + 1}
    assert [rows[i]["repeat_depth"] for i in (0, 1, n)] == [-1, 0, 0]


def test_all_items_of_a_tab_are_ordered(spark):
    """More than the index keeps: ten tabs hold the whole table, and all of it is shown."""
    items = spark.range(4100).selectExpr("1L AS tab_id", "concat('https://a/', id) AS normalized_url", "id AS first_seq", "'confirmed' AS status")
    out = index.display_order(index.capped(items, most=None)).collect()
    assert sorted(r.display for r in out) == list(range(1, 4101)) and not any(r.truncated for r in out)
    assert index.capped(items).count() == 4000
    assert "place <=" not in registry.ORACLES["ord1_display_order"]


@pytest.mark.parametrize("most", [1200, 46])
def test_dendrogram_keeps_a_forest_of_links(spark, monkeypatch, most):
    """Clusters are those of all links, in small tabs and (46: one of both) by rounds; links are thinned before they are written."""
    monkeypatch.setattr(S, "LINKS_AT_ONCE", 300)
    df = storage.written(mixed(spark))
    sizes = [r["count"] for r in df.groupBy("tab_id").count().collect()]
    assert min(sizes) <= 46 < max(sizes)
    made, write = [], S.written
    monkeypatch.setattr(S, "written", lambda x: made.append(x.columns) or write(x))
    got = S.dendrogram(df, [0.45, 0.8], most)
    assert most < 1200 or made == [["tab_id"]]
    links = S.pairs(df, 0.0).collect()
    want = {}
    for r in df.collect():
        for cut in (0.45, 0.8):
            want[r.tab_id, cut, r.seq] = r.seq
    for _ in df.collect():
        for r in links:
            for cut in (0.45, 0.8):
                if r.total >= cut:
                    x, y = (r.tab_id, cut, r.a_seq), (r.tab_id, cut, r.b_seq)
                    want[x] = want[y] = min(want[x], want[y])
    rows = got.collect()
    assert len(rows) == len(want) and {(r.tab_id, r.cut, r.seq): r.root for r in rows} == want and all(r.item == r.seq for r in rows)
    thin = S.thinned(S.pairs(df, 0.0).select("tab_id", "a_seq", "b_seq", "total").coalesce(1))
    assert thin.count() == sum(sizes) - len(sizes)

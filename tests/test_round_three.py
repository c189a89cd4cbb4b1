import os

import pytest
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.operators import similarity as S
from lodestone.plans import registry
from tests.test_similarity import GRID, grid, items

SF = "/root/testdata/sf0.001"


def copies(spark):
    """Items of few features, each several times, in two tabs: with and without paths, sizes and hosts."""
    rows = [grid(i) for i in range(4)]
    rows += [{"url": f"https://cdn.example.com/gallery/photo-{i}.jpg", "w": 400, "h": 300} for i in range(4)]
    rows += [{"url": f"https://img{i % 2}.other.net/a/b{i}.jpg", "w": 400, "h": 300, "path": GRID} for i in range(4)]
    rows += [{"url": f"https://cdn.example.com/i/icon{i}.png", "w": 16, "h": 16} for i in range(3)] + [{"url": f"rel{i}"} for i in range(3)]
    return items(spark, [r | {"tab": t} for t in (0, 1) for r in rows])


@pytest.mark.parametrize("threshold", [0.45, 0.62, 0.78, 0.8])
def test_pairs_of_classes_are_all_pairs(spark, threshold):
    df = copies(spark)
    want = {(r.tab_id, r.a, r.b, round(r.total, 9)) for r in S.pairs(df, 0.0).collect() if r.total >= threshold}
    got = S.pairs_by_class(df, threshold).collect()
    assert {(r.tab_id, r.a, r.b, round(r.total, 9)) for r in got} == want and len(got) == len(want) > 0
    totals = {r.tab_id: (r.pairs, round(r.total, 6)) for r in S.pair_totals(df, threshold).collect()}
    assert totals == {t: (sum(x[0] == t for x in want), round(sum(x[3] for x in want if x[0] == t), 6)) for t in (0, 1)}
    found, _ = S.classes(df)
    assert found.count() < df.count()


@pytest.mark.parametrize("threshold", [0.62, 0.8])
def test_copies_cluster_as_their_links_do(spark, threshold):
    df = copies(spark)
    links = S.pairs(df, threshold).select("tab_id", "a_seq", "b_seq")
    want = {}
    for r in S.components(df.select("tab_id", "seq"), links).collect():
        want.setdefault((r.tab_id, r.root), set()).add(r.seq)
    got = {}
    for r in S.cluster(df, threshold, limit=None).collect():
        got.setdefault((r.tab_id, r.cluster_id), set()).add(r.seq)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert any(len(x) == 1 for x in want.values())  # copies that do not even reach the threshold with each other


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["t11_score_pairs", "j3_balanced_pairs", "agg5_cluster", "ord1_display_order"])
def test_whole_jobs_have_ten_tabs(spark, name):
    assert "p_partkey % 10 AS tab_id" in registry.ORACLES[name]
    tabs = {r.tab_id for r in registry.QUERIES[name](spark, SF).select("tab_id").distinct().collect()}
    assert tabs <= set(range(10)) and (len(tabs) == 10 or name == "t11_score_pairs")

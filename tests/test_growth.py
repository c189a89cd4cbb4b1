"""The work of a query must not grow faster than its tables: nothing is read, shuffled or parsed more often than it needs."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import url as U
from lodestone.operators import index, similarity, upgrades
from lodestone.plans import registry
from lodestone.sources import manifests
from lodestone.streaming import tabs


SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_playlists_move_no_lines(spark):
    rows = [("https://v/x/m.m3u8", "", "#EXTM3U\n#EXTINF:1,\na.ts\n"), ("https://v/x/m.mpd", "", "<MPD/>")]
    streams = manifests.parsed(spark.createDataFrame(rows, "url string, mime_type string, body string"))
    text = plan(streams)
    assert "Exchange" not in text and "Window" not in text
    assert [r.stream.type for r in streams.orderBy("url").collect()] == ["hls", "dash"]


def test_descriptions_become_arrow_by_columns():
    rows = [manifests.dash_description(b, "u") for b in ("<MPD/>", '<MPD><A mimeType="audio/mp4"><Representation/></A><Representation id="v" bandwidth="2" width="1" height="1"/><ContentProtection/></MPD>', "", None)]
    for some in (rows, rows[:1], []):
        assert manifests._column(some, manifests._PA_STREAM).equals(pa.array(some, manifests._PA_STREAM))


def test_plain_references_resolve_as_parsed(spark):
    refs = ["a.ts", "seg/1,2.mp4", "a//b/", "a/../b", "../a", "./a", "a/.", "a/..b", ".a", "a:b", "a b", "a%2e", "/a", "?q", "#f", "//h/a", "https://o/a", "", "a?b=c", "é", "..", "a\\b"]
    bases = ["https://h/x/y?q#f", "https://h", "http://h:80/a/../b/c d/e", "https://H:8443/a/", "ftp://h/d/e", "rel/a", "", None, "https://a b/c"]
    df = spark.createDataFrame([(r, b) for r in refs for b in bases], "r string, b string")
    got = df.select("r", "b", U.resolved(F.col("r"), F.col("b"), U.folder_of(F.col("b"))).alias("x"), F.coalesce(U.href(U.parse(F.col("r"), F.col("b"))), "r").alias("y")).collect()
    assert [(r.r, r.b, r.x) for r in got] == [(r.r, r.b, r.y) for r in got]


def test_a_tab_is_no_pandas_group(spark):
    rows = [(t, i, "candidate" if i % 50 else "nav_begin", f"https://a/{i % 7}.mp4", "video", "dom") for t in (1, None, 2) for i in range(tabs.ROWS + 10)]
    df = spark.createDataFrame(rows, "tab_id long, seq long, type string, url string, kind string, source string").repartition(3)
    out = tabs.batch(df)
    assert "FlatMapGroups" not in plan(out) and "MapInArrow" in plan(out)
    got = out.collect()
    for tab in (1, None, 2):
        store, want = tabs.Store(), []
        for r in sorted((x for x in rows if x[0] == tab), key=lambda x: x[1]):
            want += tabs.apply(store, tabs._Event(*r, None, False, False))
        assert [tuple(r)[1:] for r in got if r.tab_id == tab] == want


def test_caps_read_their_items_once(spark):
    items = spark.createDataFrame([(1, "https://a/1", 1), (1, "data:x", 2)], "tab_id long, normalized_url string, first_seq long")
    out = index.capped(items)
    assert "ExistingRDD" not in plan(out) and out.count() == 2


def test_upgrade_candidates_are_made_once(spark):
    items = spark.createDataFrame([(1, 1, 1, "https://a/small/x.jpg", "image", "background", 5, 9, 9, ["dom"])], "tab_id long, item long, first_seq long, url string, kind string, status string, bytes long, width int, height int, sources array<string>")
    probes = spark.createDataFrame([("https://a/full/x.jpg", True, 50, "image/jpeg")], "url string, ok boolean, bytes long, mime_type string")
    made = storage.written(upgrades.exploded(items).select("tab_id", "item", "bytes", "pos", "candidate", "verify", "note"))
    found = upgrades.verified(items, probes, candidates=made)
    assert "Generate" not in plan(found) and found.collect() == upgrades.verified(items, probes).collect() and found.first().upgrade_bytes == 50
    out = upgrades.collapse(items.join(found, ["tab_id", "item"]))
    assert "ExistingRDD" not in plan(out) and out.first().effective_url == "https://a/full/x.jpg"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_similar_items_read_their_features_once(spark):
    assert "part.parquet" not in plan(registry.QUERIES["j5_select_similar"](spark, SF))


def test_a_pair_is_scored_once_and_nothing_is_broadcast(spark):
    rows = [(i % 2, i, i, f"https://{'ab'[i % 3 % 2]}.com/m/x{i}.jpg", "", 40.0 * (i % 4), 30.0) for i in range(12)]
    df = spark.createDataFrame(rows, "tab_id long, item long, seq long, url string, mime_type string, width double, height double")
    items = storage.written(similarity.with_features(df))
    strict = plan(similarity.pairs(items, 0.8).select("tab_id", "total"))
    assert strict.count("Generate inline") == 1 and "lambdafunction(((((0.35" not in strict
    links = storage.written(similarity.pairs(items, 0.45).select("tab_id", "a_seq", "b_seq", "total"))
    cut = similarity.cuts(items.select("tab_id", "seq", "item"), similarity.spanning_forest(links), [0.45, 0.8])
    assert not any("Broadcast" in plan(x) for x in (similarity.pairs(items, 0.45), cut)) and cut.count() == 24


def test_an_address_gets_its_key_once(spark):
    rows = [("https://a/x.jpg?utm_a=1", m, "", w, 5, b) for m in ("", "image/jpeg") for w in (None, 5) for b in (None, 7)] + [(None, "", "", 1, 1, None)] * 2
    out = index.prepared(spark.createDataFrame(rows, "url string, mime_type string, kind string, width int, height int, bytes long"))
    assert "row_number" in plan(out)
    got = out.collect()
    assert len(got) == 10 and {(r.url, r.normalized_url) for r in got} == {("https://a/x.jpg?utm_a=1", "https://a/x.jpg"), (None, "")}

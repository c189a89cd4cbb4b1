from pyspark.sql import functions as F

from lodestone.functions import media as M
from lodestone.operators import crawl, downloads, index, upgrades
from lodestone.sources import manifests, network
from lodestone.streaming import tabs


def test_jobs_after_a_restart(spark):
    jobs = spark.createDataFrame([("a", 1, "running", 1, ""), ("b", 2, "running", 1, ""), ("c", 3, "running", 3, ""), ("d", None, "queued", 0, ""), ("e", 5, "running", 1, "")], "job string, download_id long, state string, tries int, error string")
    known = spark.createDataFrame([(1, "complete", None), (2, "interrupted", "CRASH"), (5, "in_progress", None)], "download_id long, state string, error string")
    out = {r.job: (r.state, r.error) for r in downloads.resumed(jobs, known).collect()}
    assert out == {"a": ("done", ""), "b": ("backoff", "CRASH"), "c": ("failed", "NETWORK_FAILED"), "d": ("queued", ""), "e": ("running", "")}
    assert {r.job: r.state for r in downloads.stopped(jobs).collect()}["d"] == "cancelled"
    failed = spark.createDataFrame([(1, i, "failed") for i in range(8)] + [(1, 9, "done")], "tab_id long, seq long, state string")
    assert [r.seq for r in downloads.recent_errors(failed).collect()] == [3, 4, 5, 6, 7]
    sessions = spark.createDataFrame([("x", True, 0), ("y", True, 900_000), ("z", False, None)], "id string, finished boolean, finished_at long")
    assert sorted(r.id for r in downloads.reaped(sessions, 1_000_000).collect()) == ["y", "z"]
    kinds = spark.createDataFrame([("data:x", False), ("https://a", True), ("canvas:1", False), ("https://a", False)], "u string, h boolean")
    assert [r[0] for r in kinds.select(downloads.route(F.col("u"), F.col("h"), ("canvas",))).collect()] == ["inline", "har", "capture", "network"]


def test_index_views(spark):
    schema = "tab_id long, first_seq long, id string, normalized_url string, url string, kind string, status string, bytes double, structural_path array<struct<tag:string,classes:array<string>>>, class_counts map<string,int>, repeat_depth int, in_repeated_group boolean"
    rows = [(1, 1, "1-1", "https://a/x", "https://a/x?utm_a=1", "image", "confirmed", 5.0, [("img", [])], {"a": 1}, 2, True), (1, 2, "1-2", "https://a/v", "https://a/v", "video", "protected", 7.0, [], {}, -1, False), (1, 3, "1-3", "https://a/s", "https://a/s", "stream", "background", None, [], {}, -1, False)]
    items = spark.createDataFrame(rows, schema)
    assert [r.id for r in index.similar_pool(items).collect()] == ["1-1"] == [r.id for r in index.downloadable(items).collect()]
    light = index.lighten(items).where("id = '1-1'").first()
    assert (light.structural_path, light.class_counts, light.repeat_depth, light.in_repeated_group) == ([], {}, -1, False)
    assert tuple(index.totals(items).first()) == (1, 3, 12.0)
    chosen = spark.createDataFrame([(1, "1-1"), (1, "1-2")], "tab_id long, id string")
    assert tuple(index.totals(items, chosen).first()) == (1, 1, 5.0)
    wanted = spark.createDataFrame([(1, "1-2"), (1, "https://a/x"), (1, "https://a/x?utm_a=1"), (1, "none")], "tab_id long, key string")
    found = {r.key: r.item and r.item.id for r in index.lookup(items.where("id <> '1-2'"), items.where("id = '1-2'"), wanted).collect()}
    assert found == {"1-2": "1-2", "https://a/x": "1-1", "https://a/x?utm_a=1": "1-1", "none": None}


def test_counters_and_marks(spark):
    checked = spark.createDataFrame([(1, True), (1, False)], "tab_id long, upgrade_verified boolean")
    merged = spark.createDataFrame([(1, 2), (1, 0)], "tab_id long, merged_duplicates long")
    assert tuple(upgrades.batch_counters(checked, checked, merged).first()) == (1, 2, 1, 2)
    elements = spark.createDataFrame([(1, i, "button", True, 900.0, t) for i, t in enumerate(("next", "buy", "zoom"))], "page_id long, pos long, tag string, visible boolean, area double, text string")
    assert tuple(crawl.judge_counts(crawl.judged(elements)).first()) == (1, [0, 2], 1)
    items = spark.createDataFrame([("https://a/m.m3u8", "background"), ("https://a/x", "confirmed")], "url string, status string")
    streams = manifests.parsed(spark.createDataFrame([("https://a/m.m3u8", "", '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k"')], "url string, mime_type string, body string"))
    marked = {r.url: (r.status, r.protected_reason) for r in manifests.mark_protected(items, streams).collect()}
    assert marked["https://a/m.m3u8"][0] == "protected" and marked["https://a/x"] == ("confirmed", None)
    uris = spark.createDataFrame([("data:image/png;base64,A",), ("data:,x",), ("https://a",)], "u string")
    assert [r[0] for r in uris.select(M.data_uri_mime(F.col("u"))).collect()] == ["image/png", "", ""]


def test_page_messages(spark):
    df = spark.createDataFrame([(1, 1, i, u, "https://p/") for i, u in enumerate(("https://a/x", "#", "/rel", "javascript:x"))], "tab_id long, batch long, pos long, url string, page_url string")
    assert [(r.url, r.source, r.status) for r in network.bridged(df).orderBy("pos").collect()] == [("https://a/x", "main", "background"), ("https://p/rel", "main", "background")]
    blobs = spark.createDataFrame([("blob:1", True, ""), ("blob:2", False, "video/mp4"), ("blob:3", False, "text/plain")], "url string, is_media_source boolean, mime_type string")
    assert [(r.url, r.kind) for r in network.media_source(blobs).collect()] == [("blob:1", "stream"), ("blob:2", "video")]
    rows = spark.createDataFrame([(1, "r"), (2, "r")], "tab_id long, x string")
    assert [r.tab_id for r in tabs.pruned(rows, spark.createDataFrame([(2,)], "tab_id long")).collect()] == [2]

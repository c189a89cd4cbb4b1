import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import media
from lodestone.plans import registry, views
from lodestone.sources import dom, har, manifests, network, payloads, rules
from lodestone.sources.pieces import pieces
from lodestone.streaming import tabs


def test_har(spark, tmp_path):
    entry = lambda url, mime, status=200, text="", encoding="", size=10: {"startedDateTime": "2024-01-01T00:00:00Z", "request": {"url": url}, "response": {"status": status, "bodySize": -1, "headers": [{"name": "Content-Type", "value": mime}], "content": {"mimeType": mime, "size": size, "text": text, "encoding": encoding}}}
    log = [entry("https://a/x.png", "image/png", text="aGVs\nbG8=", encoding="base64"), entry("https://a/x.png?utm_source=1", "image/png"), entry("https://a/", "text/html"), entry("https://a/y.png", "image/png", 404), entry("https://a/s.m3u8", "application/x-mpegurl", text="#EXTM3U")]
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": log}}))
    (tmp_path / "b.har").write_text("{nope")
    archives = har.read(spark, f"file://{tmp_path}")
    assert sorted(r.error for r in har.errors(archives).collect()) == ["", "not valid JSON"]
    rows = {r.url: r for r in har.with_bodies(har.candidates(archives)).collect()}
    assert set(rows) == {"https://a/x.png", "https://a/s.m3u8"} and bytes(rows["https://a/x.png"].body) == b"hello" and rows["https://a/x.png"].timestamp == 1704067200000
    assert [(r["items"], r.skipped) for r in har.skipped(archives).collect()] == [(2, 2)]
    small = har.with_bodies(har.candidates(archives), total=6).where("har_body").collect()
    assert [r.url for r in small] == ["https://a/x.png"]


def test_network(spark):
    schema = "tab_id long, url string, type string, headers array<struct<name:string,value:string>>"
    rows = [(1, "https://a/x", "image", [("Content-Type", "image/png"), ("CONTENT-LENGTH", "12")]), (1, "https://a/x.jpg", "script", []), (-1, "https://a/x.jpg", "image", []), (1, "https://a/v.mp4", "media", [("content-length", "0")])]
    df = spark.createDataFrame(rows, schema)
    assert {(r.url, r.kind, r.bytes) for r in network.headers_received(df).collect()} == {("https://a/x", "image", 12.0), ("https://a/v.mp4", "video", None)}
    assert [r.url for r in network.before_request(df).collect()] == ["https://a/v.mp4"]
    kinds = spark.createDataFrame([("application/json",), ("image/png",), ("text/html",), ("",)], "t string")
    assert [r[0] for r in kinds.select(network.payload_action(F.col("t"), F.lit(True), F.lit(10))).collect()] == ["walk", "report", "skip", "walk"]


def test_payloads(spark):
    body = json.dumps({"a": ["/media/one.jpg", "text"], "b": {"c": "https://x.com/two.mp4"}, "d": "https://x.com/app.js"})
    df = spark.createDataFrame([(1, "https://page.com/p/q", body), (2, "https://page.com/", "{broken"), (3, "https://page.com/", None)], "id long, url string, body string")
    assert [(r.id, r.found) for r in payloads.mine(df).orderBy("pos").collect()] == [(1, "https://x.com/two.mp4"), (1, "https://page.com/media/one.jpg")]
    deep = "[" * 14 + '"/media/x.jpg"' + "]" * 14
    assert payloads.strings(deep) == [] and payloads.strings("5") == [] and payloads.strings('"x"') == ["x"]


HTML = """<html><body><main class="gallery"><img class="hero" src="/hero.jpg"><ul class="grid">
<li class="item"><a href="/full/1.jpg"><img class="thumb" src="/t/1.jpg" srcset="/t/1.jpg 1x, /t/1b.jpg 2x"></a></li>
<li class="item"><a href="/page"><img class="thumb" src="/t/2.jpg"></a></li><li class="item"><img class="thumb" data-src="/t/3.jpg"></li></ul>
<video src="/v.mp4" poster="/p.jpg"><source src="/v.webm" type="video/webm"><track src="/c.vtt"></video>
<a href="/song.mp3">x</a><a href="/about">y</a><div style="background-image: url('/bg/photo.png')"></div><img src="/hero.jpg"></main></body></html>"""


def test_dom(spark):
    df = spark.createDataFrame([(1, "https://a.com/x/", HTML), (2, "https://a.com/", None)], "page_id long, url string, html string")
    rows = {r.url.removeprefix("https://a.com"): r for r in dom.candidates(df).collect()}
    assert set(rows) == {"/hero.jpg", "/t/1b.jpg", "/full/1.jpg", "/t/2.jpg", "/t/3.jpg", "/v.mp4", "/p.jpg", "/v.webm", "/c.vtt", "/song.mp3", "/bg/photo.png"}
    assert rows["/t/1b.jpg"].repeat_depth == 2 and rows["/hero.jpg"].repeat_depth == -1 and rows["/full/1.jpg"].preview_url == "https://a.com/t/1b.jpg"
    assert rows["/t/1b.jpg"].class_counts == {"thumb": 3, "item": 3, "grid": 1, "gallery": 1}
    assert [n.tag for n in rows["/hero.jpg"].structural_path] == ["img", "main", "body"] and rows["/v.webm"].mime_type == "video/webm" and rows["/p.jpg"].poster


MASTER = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="En, glish",LANGUAGE="en",DEFAULT=YES,URI="a/en.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1,mp4a"\nlow.m3u8\n#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=2000000\nhigh.m3u8\n'
MEDIA = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-MAP:URI=\"init.mp4\"\n#EXTINF:6.0,\ns1.ts\n#EXTINF:4.5,x\ns2.ts\n"
MPD = '<MPD xmlns="urn:x" xmlns:c="urn:y" type="static" mediaPresentationDuration="PT1M30.5S"><Period><AdaptationSet contentType="video" mimeType="video/mp4">{p}<Representation id="v1" bandwidth="500000" width="640" height="360" codecs="avc1"/><Representation id="v2" bandwidth="900000"/></AdaptationSet><AdaptationSet mimeType="audio/mp4" lang="en"><Representation bandwidth="64000"/></AdaptationSet></Period></MPD>'


def parsed(spark, *bodies, url="https://v/x/m.m3u8"):
    rows = [(f"{url}?{i}", "", body) for i, body in enumerate(bodies)]
    out = manifests.parsed(spark.createDataFrame(rows, "url string, mime_type string, body string")).collect()
    return [r.stream for r in sorted(out, key=lambda r: r.url)]


def test_playlists(spark):
    hls, media, page, broken, empty, none = parsed(spark, MASTER, MEDIA, "<html>", "#EXTM3U\nhttp://[x\n#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXT-X-STREAM-INF:BANDWIDTH=x,AVERAGE-BANDWIDTH=7\n\n# note\nv\ns\n", "", None)
    assert [(v.url, v.bandwidth) for v in hls.variants] == [("https://v/x/high.m3u8", 2000000.0), ("https://v/x/low.m3u8", 800000.0)]
    assert hls.audio_tracks[0].name == "En, glish" and hls.audio_tracks[0].url == "https://v/x/a/en.m3u8" and hls.audio_tracks[0].is_default and hls.master and not hls.live and hls.variants[1].codecs == "avc1,mp4a"
    assert media.segments == [f"https://v/x/{s}" for s in ("init.mp4", "s1.ts", "s2.ts")] and media.duration == 10.5 and media.live
    assert page.type == "dash" and page.variants == []
    assert broken.segments == ["http://[x", "https://v/x/s"] and [(v.url, v.bandwidth) for v in broken.variants] == [("https://v/x/v", 7.0)]
    assert empty == none and empty.type == "hls" and empty.variants == empty.segments == [] and not empty.master and not empty.encrypted
    keys = ["#EXT-X-KEY:METHOD=NONE", '#EXT-X-KEY:URI="k"', '#EXT-X-KEY:METHOD=SAMPLE-AES,KEYFORMAT="com.apple.streamingkeydelivery"', '#EXT-X-SESSION-KEY:METHOD=NONE,KEYFORMAT="Some.Widevine', '#EXT-X-KEY:METHOD=AES-128\n#EXT-X-KEY:METHOD=NONE', "#EXT-X-KEY"]
    found = [(s.encrypted, s.encryption_method, s.key_systems) for s in parsed(spark, *("#EXTM3U\n" + k for k in keys))]
    assert found == [(False, "", []), (True, "UNDECLARED", []), (True, "SAMPLE-AES", ["fairplay"]), (True, "UNDECLARED", ["widevine"]), (True, "AES-128", []), (False, "", [])]


def test_dash(spark):
    clean, locked, root, malformed, entities, mixed = parsed(
        spark, MPD.format(p=""), MPD.format(p='<c:ContentProtection schemeIdUri="urn:uuid:EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED"/>'), "<Representation/>", "<MPD", '<!DOCTYPE x [<!ENTITY a "b">]><MPD type="dynamic"/>',
        MPD.format(p='<ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cbcs"/><ContentProtection schemeIdUri="x"/>'), url="https://v/m.mpd",
    )
    assert [v.id for v in clean.variants] == ["v2", "v1"] and clean.duration == 90.5 and len(clean.audio_tracks) == 1 and not clean.encrypted and clean.variants[1].resolution == "640x360"
    assert locked.encrypted and locked.key_systems == ["widevine"] and locked.encryption_method == "CENC" and [v.id for v in locked.variants] == ["v2", "v1"]
    assert [v.id for v in root.variants] == ["0"] and not root.live
    assert malformed.variants == [] and entities.variants == [] and not entities.live
    assert mixed.encryption_method == "CBCS" and mixed.key_systems == []
    assert [manifests.iso_duration(x) for x in ("P1DT1H", "x", "PT1M30.5S", "P1M", "PT1M", "PT1S1H", "P1Y2D", "PT", "P1H", None)] == [90000, 0, 90.5, 2_592_000, 60, 0, 31_536_000 + 172_800, 0, 0, 0]


def test_manifests(spark):
    df = spark.createDataFrame([("https://v/x/m.m3u8", "", MASTER), ("https://v/x/low.m3u8", "", MEDIA), ("https://v/d", "application/dash+xml", MPD.format(p=""))], "url string, mime_type string, body string")
    streams = manifests.parsed(df)
    assert manifests.variants(streams).where("manifest = 'https://v/d'").orderBy("pos").first().size == "9.7 MB"
    chosen = spark.createDataFrame([("https://v/x/m.m3u8", "https://v/x/low.m3u8")], "manifest string, variant string")
    assert manifests.segment_list(streams, chosen).first().segments == [f"https://v/x/{s}" for s in ("init.mp4", "s1.ts", "s2.ts")]
    assert manifests.tracks(streams).count() == 2 and manifests.segments(streams).count() == 3


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version": 1,\n "rules": [{"match": "a.com", "find": "x", "replace": "y", "verify": false}]}')
    assert rules.load(spark, f"file://{tmp_path}/r.json") == [{"match": "a.com", "find": "x", "replace": "y", "verify": False}]
    assert rules.load(spark, f"file://{tmp_path}/none.json") == []


def test_table_functions(spark):
    from lodestone.plans import functions

    functions.register(spark)
    assert [r.value for r in spark.sql("""SELECT * FROM media_urls('{"a": ["/x.jpg", "y"]}', 'https://a')""").collect()] == ["y", "/x.jpg"]
    assert spark.sql("SELECT * FROM dom_candidates('<img src=\"/a.png\">')").first().url == "/a.png"
    df = spark.createDataFrame([(MASTER,)], "body string")
    df.createOrReplaceTempView("manifests_in")
    assert spark.sql("SELECT m.* FROM manifests_in, LATERAL parse_manifest(body, 'https://v/m.m3u8', '') m").count() == 2


def test_har_query_reads_every_row(spark, tmp_path):
    part = spark.range(0, 50_000, 10).selectExpr("id AS p_partkey", "'STEEL' AS p_type", "'red box' AS p_name", "CAST(id / 10 AS INT) % 50 AS p_size", "1000.0D AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = {r.url for r in registry.src17_har(spark, str(tmp_path)).collect()}
    rows = views.candidates(spark, str(tmp_path)).where("item_seq % 17 <> 0")
    accepted = rows.where((media.classify(F.col("url"), F.lit("")) != "") & (media.rejection_reason(F.col("url"), F.lit(0), F.lit(0), F.col("bytes")) == ""))
    assert got == {r.url for r in accepted.collect()} and len(got) > 3800


def test_drawings(spark):
    html = "<svg width='20' height='8px'><svg width='90' height='90'></svg></svg><svg width='7' height='90'></svg><svg width='50%' height='9'></svg><canvas></canvas><canvas width='12.7' height='3'></canvas><canvas width='0'></canvas>"
    assert dom.drawings_of(html) == [("svg", 0, 20.0, 8.0), ("canvas", 4, 300.0, 150.0), ("canvas", 5, 12.0, 3.0)] and dom.drawings_of(None) == []
    pages = spark.createDataFrame([(1, "https://a/", html, 9), (2, None, None, 9)], "page_id long, url string, html string, seq int")
    out = dom.drawings(pages, "drawn", spark.createDataFrame([(1, 4), (1, 0)], "page_id long, element int")).orderBy("seq").collect()
    assert [(r.url, r.status, r.protected_reason != "") for r in out] == [("drawn-svg:0", "confirmed", False), ("drawn-canvas:4", "unavailable", True), ("drawn-canvas:5", "confirmed", False)]


def test_archives_in_parts(spark, tmp_path):
    """Split every few hundred bytes, an archive gives the rows that it gives as a whole: keys before the time, entries without
    one, pages, escapes, the key inside texts, and an archive in which the key is a value."""
    rng = random.Random(1)

    def entry(i):
        body = {"text": 'say "startedDateTime" {[' + "x" * rng.randint(0, 200) + "\\\" }", "mimeType": "image/png", "size": i}
        out = {"startedDateTime": f"2024-01-01T00:00:{i % 60:02}Z", "request": {"url": f"https://a.com/{i}.png?q={{[", "headers": []}, "response": {"status": 200, "bodySize": i, "content": body, "headers": [{"name": "Content-Length", "value": "5"}]}}
        if i % 3 == 1:
            out = {"_priority": {"a": [1, {"b": "}"}]}, "pageref": "p"} | out
        if i % 7 == 5:
            del out["startedDateTime"]
        return out

    pages = [{"startedDateTime": "2024-01-01T00:00:00Z", "id": "p", "pageTimings": {}}] * 3
    logs = {"a": {"log": {"creator": {"name": "x"}, "pages": pages, "entries": [entry(i) for i in range(60)]}}, "b": {"log": {"entries": [entry(5), entry(1)], "pages": pages}}, "c": {"log": {"entries": [entry(2) | {"comment": "startedDateTime"}, entry(3)]}}, "d": {"log": {"entries": []}}}
    for name, log in logs.items():
        (tmp_path / f"{name}.har").write_text(json.dumps(log, indent=1 if name == "a" else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = har.entries_in_parts(spark, str(tmp_path)).collect()
        n = spark.read.option("lineSep", '"startedDateTime"').text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = har.entries(spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("archive"), F.col("value").alias("text"))).collect()
    key = lambda rows: sorted(map(repr, rows))
    assert n > 8 and len(want) == 64 and key(got) == key(want)
    assert har.cut(': 1, "a": {"b": 2}}, {"c": [{}]}, {"d": ', False) == (': 1, "a": {"b": 2}}', ['{"c": [{}]}'], '{"d": ')


def test_batches_come_in_pieces(spark):
    """Python holds the objects of a piece of a batch at a time, never of all its pages."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(50)), "html": ["x" * 100] * 49 + ["y" * 5000]})
    cut = list(pieces([batch.slice(0, 0), batch], 1000))
    assert [n for b in cut for n in b.column(0).to_pylist()] == list(range(50)) and max(b.num_rows for b in cut) <= 5
    assert [b.num_rows for b in pieces([batch], 1)] == [1] * 50
    img = lambda i: f'<body><img src="/{i}.png"></body>' + " " * 20000
    pages = spark.createDataFrame([(i, f"https://a/{i}", img(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    assert sorted(r.url for r in dom.candidates(pages).collect()) == sorted(f"https://a/{i}.png" for i in range(60))

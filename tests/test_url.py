import pytest
from pyspark.sql import functions as F

from lodestone.functions import hosts
from lodestone.functions import media as M
from lodestone.functions import paths as X
from lodestone.functions import url as U

NOW = 1_700_000_000_000


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("u")).alias("x")).collect()]


def test_normalize(spark):
    cases = {
        "https://Example.COM/a": "https://example.com/a",
        "https://example.com:443/a/": "https://example.com/a",
        "http://example.com:80/a#x": "http://example.com/a",
        "http://example.com:8080/a": "http://example.com:8080/a",
        "https://example.com/a?utm_source=1&b=2&A=1&fbclid=9&_ga=4": "https://example.com/a?a=1&b=2",
        "https://example.com/a?b=2&b=1&token=x": "https://example.com/a?b=1&b=2&token=x",
        "https://example.com/a?_nc_sid=1&ref=z": "https://example.com/a?_nc_sid=1&ref=z",
        "//example.com/a/../b": "https://example.com/b",
        "https://example.com": "https://example.com/",
        "https://example.com/é a?q=ü b*~": "https://example.com/%C3%A9%20a?q=%C3%BC+b*%7E",
        " data:image/png;base64,A ": "data:image/png;base64,A",
        "blob:https://x/1": "blob:https://x/1",
        "not a url": "not a url",
        "mailto:a@b": "mailto:a@b",
        "": "",
        None: "",
    }
    assert column(spark, U.normalize_url, list(cases)) == list(cases.values())


def test_resolution(spark):
    rows = [("../x/y?z", "https://a.b/c/d/e?f#g", "https://a.b/c/x/y?z"), ("?q=1", "https://a.b/c/d", "https://a.b/c/d?q=1"), ("#h", "https://a.b/c?d=1", "https://a.b/c?d=1"), ("/r", "http://a.b:8080/c", "http://a.b:8080/r")]
    rows += [("k", "https://a.b", "https://a.b/k"), ("x", None, ""), ("..", "https://a.b/c/d", "https://a.b/"), ("a\\b", "https://a.b/", "https://a.b/a/b")]
    df = spark.createDataFrame(rows, "u string, b string, e string")
    assert all(r[0] == r[1] for r in df.select("e", U.crawl_key(F.col("u"), F.col("b"))).collect())


def test_hosts_and_patterns(spark):
    assert column(spark, U.bare_host, ["www2.A.com:80", "m.www.a.com", "amp.x.y", "wwwx.a"]) == ["a.com", "www.a.com", "x.y", "wwwx.a"]
    assert column(spark, U.registrable_domain, ["img.shop.co.uk", "a.b.c.d", "localhost", "b.co"]) == ["shop.co.uk", "c.d", "localhost", "b.co"]
    p = column(spark, U.pattern_of, ["https://cdn.a.com/2020/deadbeef12/IMG_12-150x150.JPG?w=3&H=2&x=1", "https://a.com/file", "https://a.com", "data:x", "rel"])
    assert (p[0].dir, p[0].file, p[0].ext, p[0].pattern, p[0].sizeKey) == ("/*/*", "img_#-#x#.jpg", "jpg", "/*/*/img_#-#x#.jpg", "h=2&w=3")
    assert p[0].tokens == ["img", "150x150", "jpg"]
    assert [x.pattern for x in p[1:]] == ["//file", "//", "data:", ""]
    assert column(spark, U.generic_filename, ["0123456789ab.png", "a1b2c3d4e5f6.png", "a1b2-c3d4e5f6.png", ".hidden"]) == ["*.png", "*.png", "a#b#-c#d#e#f#.png", ".hidden"]


def test_expiry(spark):
    cases = {
        "https://h/x?X-Amz-Date=20240101T000000Z&X-Amz-Expires=60": (True, 1704067260000),
        "https://h/x?Expires=1700000000": (True, 1700000000000),
        "https://h/x?se=2024-05-01T00:00:00Z": (True, 1714521600000),
        "https://h/x?se=Wed, 01 May 2024 00:00:00 GMT": (True, 1714521600000),
        "https://h/x?oe=65F00000": (True, 1710227456000),
        "https://h/x?expires=1700000000000": (True, 1700000000000),
        "https://h/x?sig=1": (True, None),
        "https://h/x?Sig=1": (False, None),
        "https://h/x": (False, None),
    }
    assert [tuple(r) for r in column(spark, lambda u: U.expiry(u, F.lit(NOW)), list(cases))] == list(cases.values())


def test_media(spark):
    assert column(spark, M.ext_of, ["https://a/x.JPG?y", "https://a/get?file=photo.png", "https://a/x.tar.gz", "https://a/.x", "https://a/x#y.jpg", "https://a/x."]) == ["jpg", "png", "gz", "", "", ""]
    assert column(spark, M.kind_from_mime, ["image/png; q", "application/dash+xml", "AUDIO/mpegurl", "text/html", None]) == ["image", "stream", "stream", "", ""]
    assert column(spark, M.ext_from_mime, ["image/jpeg", "video/mpeg", "audio/x-wav", "image/vnd.microsoft.icon", "image/x-icon"]) == ["jpg", "mp3", "wav", "", "ico"]
    media = ["https://a.cdn.x/abcdefgh", "https://cdn.x/abcdefgh", "https://x/images/abcdefgh", "https://x/images/a.html", "/a/b.webp", "x.jpg", "https://x/images/abc"]
    assert column(spark, M.looks_like_media, media) == [True, False, True, False, True, False, False]
    assert column(spark, M.data_uri_bytes, ["data:image/png;base64,AAAAAAAA", "data:,abc", "https://x"]) == [6, 3, 0]
    assert [M.resolve_threshold(v) for v in (0, 2, "strict", "0.5", "", None, "x")] == [0.0, 0.95, 0.8, 0.5, 0.62, 0.62, 0.62]
    assert M.threshold_name(0.7) == "balanced" and M.threshold_name(0.75) == "strict"


@pytest.mark.parametrize("width,height,size,reason", [(1, 1, 43, "tracking-pixel"), (1, 1, None, ""), (0, 0, 43, ""), (2, 3, 43, "")])
def test_rejection(spark, width, height, size, reason):
    df = spark.createDataFrame([("https://a/x.gif", width, height, size)], "u string, w int, h int, b long")
    assert df.select(M.rejection_reason(F.col("u"), F.col("w"), F.col("h"), F.col("b"))).first()[0] == reason
    urls = ["https://a/favicon.ico?x", "data:image/x-icon;base64,AA", "data:image/png;base64,AA", "data:image/png;base64," + "A" * 2000]
    assert column(spark, lambda u: M.rejection_reason(u, F.lit(0), F.lit(0), F.lit(None).cast("long")), urls) == ["favicon", "favicon", "tiny-data-uri", ""]


def test_paths(spark):
    names = ["a/b:c", "  x  y ", "..", "con.txt", "..a..b..", "é" * 120 + ".jpeg", "", "\x01a\x7f", "😀" * 80]
    out = column(spark, X.sanitize_segment, names)
    assert out[:5] == ["a_b_c", "x y", "file", "_con.txt", "a.b"] and out[5] == "é" * 95 + ".jpeg" and out[6:8] == ["file", "a"] and out[8] == "😀" * 50
    assert column(spark, X.basename_of, ["https://a/b%20c.jpg", "https://a/", "data:x", "blob:x", "nope", "https://a/%zz.png"]) == ["b c", "index", "inline", "blob", "file", "%zz"]
    sizes = spark.createDataFrame([(v,) for v in (0.0, 512.0, 1536.0, 104857600.0, 1.2e15)], "v double").select(X.format_bytes(F.col("v"))).collect()
    assert [r[0] for r in sizes] == ["—", "512 B", "1.5 KB", "100 MB", "1091 TB"]
    assert column(spark, X.urls_from_css, ["url(a.png), url('b c.jpg') x url(\"d\")", "none"]) == [["a.png", "b c.jpg", "d"], []]
    quoted = column(spark, lambda u: X.download_command(u, referer=F.lit("r"), cookie=F.lit("c=1"), browser=F.lit("b")), ["it's"])[0]
    assert quoted == "yt-dlp --referer 'r' --add-header 'Cookie: c=1' 'it'\\''s'"
    assert column(spark, lambda u: X.remux_command(u, referer=F.lit("r")), ["u"])[0] == "ffmpeg -headers 'Referer: r\r\n' -i 'u' -c copy 'out.mp4'"


def test_srcset():
    assert X.best_of_srcset("a.jpg 1x, b.jpg 2x, c.jpg") == "b.jpg"
    assert X.best_of_srcset("a,b.jpg 300w, c.jpg 600w") == "c.jpg"
    assert X.best_of_srcset("a.jpg, b.jpg") == "a.jpg" and X.best_of_srcset(None) == ""
    assert X.parse_srcset("x (a,b), y 1x") == [("x", "(a,b)"), ("y", "1x")]


HOSTS = [
    ("EXAMPLE.com", "example.com"), ("faß.de", "xn--fa-hia.de"), ("bücher.example", "xn--bcher-kva.example"), ("日本語。ＪＰ", "xn--wgv71a119e.jp"), ("ex%41mple.com", "example.com"), ("a\u00adb.com", "ab.com"),
    ("127.1", "127.0.0.1"), ("0x7f.0.0.1", "127.0.0.1"), ("0177.0.0.01", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("1.2.3.4.", "1.2.3.4"), ("0xffffffff", "255.255.255.255"), ("0x", "0.0.0.0"), ("a.0x1", None),
    ("256.1.1.1", None), ("1.2.3.4.5", None), ("4294967296", None), ("09", None), ("1.2.3.08", None), ("foo.1", None), ("a b", None), ("a%00b", None), ("", None), ("%ff", None),
    ("[::1]", "[::1]"), ("[2001:DB8:0:0:1:0:0:1]", "[2001:db8::1:0:0:1]"), ("[1:0:2:3:4:5:6:7]", "[1:0:2:3:4:5:6:7]"), ("[::ffff:1.2.3.4]", "[::ffff:102:304]"), ("[::]", "[::]"), ("[fe80::1%25eth0]", None), ("[::1", None), ("[g::]", None),
]


def test_hosts(spark):
    assert [(h, hosts.ascii_host(h)) for h, _ in HOSTS] == HOSTS
    urls = [("https://user@MÜNCHEN.example:8080/ü?q#f", "https://xn--mnchen-3ya.example:8080/%C3%BC?q#f"), ("//127.1/x", "https://127.0.0.1/x"), ("http://[2001:DB8::0:1]:80/", "http://[2001:db8::1]/"), ("https://plain.example.com/ü", "https://plain.example.com/%C3%BC"), ("/ü", None), ("http://256.256.256.256.1/", None), (None, None), ("http://x.0xfg/", "http://x.0xfg/")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, u string")
    got = [r.h for r in df.select("i", U.href(U.parse(hosts.ascii_url(F.col("u")))).alias("h")).orderBy("i").collect()]
    assert got[:5] == [w for _, w in urls[:5]] and got[6:] == [w for _, w in urls[6:]]

import itertools
import random

from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import policy as P
from lodestone.functions import upgrades as G
from lodestone.operators import crawl, downloads, index, upgrades

S = "tab_id long, seq long, url string, mime_type string, kind string, width double, height double, bytes double, source string, status string, preview_url string"


def fold_status(seen):
    """The pairwise rule, one sighting after another."""
    status, sources = None, set()
    for source, own in seen:
        sources.add(source)
        own = own or ("referenced" if source == "dom" else "background")
        if status is None:
            status = own
        elif "protected" in (status, own):
            status = "protected"
        elif "confirmed" in (status, own) or ("dom" in sources and len(sources) > 1):
            status = "confirmed"
        elif sources - {"dom"}:
            status = "background"
        elif "unavailable" in (status, own):
            status = "unavailable"
        else:
            status = "referenced"
    return status


def test_status_is_independent_of_order(spark):
    every = [(s, t) for s in K.SOURCES for t in K.STATUSES]
    rng = random.Random(1)
    cases = [[x] for x in every] + [list(x) for x in itertools.product(every, repeat=2)] + [rng.choices(every, k=rng.randint(3, 5)) for _ in range(200)]
    rows = [(i, j, "https://a/x.jpg", "", "image", 0.0, 0.0, None, s, t, "") for i, c in enumerate(cases) for j, (s, t) in enumerate(c)]
    out = index.merge(index.accepted(index.prepared(spark.createDataFrame(rows, S)))).collect()
    assert {r.tab_id: r.status for r in out} == {i: fold_status(c) for i, c in enumerate(cases)}


def test_merge(spark):
    rows = [
        (1, 1, "https://a/x.gif", "", "", 1.0, 1.0, 43.0, "dom", "referenced", ""),
        (1, 2, "https://a/x.gif?utm_source=1", "", "", 0.0, 0.0, 0.0, "net", "background", "p1"),
        (1, 3, "https://a/x.gif", "image/gif", "", 10.0, 5.0, 99.0, "har", "background", "p2"),
        (1, 4, "https://a/page.html", "", "", 0.0, 0.0, None, "net", "background", ""),
        (1, 5, "https://a/v.mp4", "", "", 0.0, 0.0, None, "net", "background", ""),
    ]
    seen = index.prepared(spark.createDataFrame(rows, S))
    assert [tuple(r) for r in index.counters(seen).collect()] == [(1, 2, 1, 1)]
    tabs = spark.createDataFrame([(1,)], "tab_id long")
    out = {r.normalized_url: r for r in index.merge(index.accepted(seen), tabs).collect()}
    gif = out["https://a/x.gif"]
    assert (gif.url, gif.bytes, gif.width, gif.mime_type, gif.sources, gif.preview_url, gif.status, gif.sightings) == ("https://a/x.gif?utm_source=1", 0.0, 10.0, "image/gif", ["net", "har"], "p2", "background", 2)
    assert out["https://a/v.mp4"].status == "protected" and len(out) == 2


def test_caps(spark):
    rows = [(1, i, "data:," + "x" * n, "data:," + "x" * n) for i, n in enumerate((40, 70, 30))] + [(1, 10 + i, f"https://a/{i}", f"https://a/{i}") for i in range(4)]
    items = spark.createDataFrame(rows, "tab_id long, first_seq long, url string, normalized_url string")
    out = index.capped(items, most=4, data_budget=100).orderBy("first_seq").collect()
    assert [(r.first_seq, r.id, r.truncated) for r in out] == [(0, "1-1", True), (2, "1-2", True), (10, "1-3", True), (11, "1-4", True)]


def test_sanitize_and_codecs(spark):
    raw = spark.createDataFrame([(1, 1, "javascript:x", "a" * 200, -3.0, "odd"), (1, 2, " https://a/x.jpg ", "a" * 200, -3.0, "net"), (1, 3, "capture:1", "", 5.0, "dom")], "tab_id long, seq long, url string, mimeType string, width double, source string")
    out = index.sanitize(raw, ("capture",)).orderBy("seq").collect()
    assert [(r.url, len(r.mime_type), r.width, r.source, r.status, r.repeat_depth) for r in out] == [("https://a/x.jpg", 128, 0.0, "net", "referenced", -1), ("capture:1", 0, 5.0, "dom", "referenced", -1)]
    df = spark.createDataFrame([([("li", ["a", "b"]), ("ul", [])], {"a": 2, "b": 1})], "p array<struct<tag:string,classes:array<string>>>, n map<string,int>")
    r = df.select(index.pack_path("p").alias("p"), index.pack_counts(F.col("n")).alias("n")).select("p", "n", index.unpack_path(F.col("p")).alias("up"), index.unpack_counts(F.col("n")).alias("un")).first()
    assert r.p == ["li a b", "ul"] and r.n == "a 2 b 1" and [(x.tag, x.classes) for x in r.up] == [("li", ["a", "b"]), ("ul", [])] and r.un == {"a": 2, "b": 1}


def generic(spark, *urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i")
    return [r[0] for r in df.select(G.generic(F.col("u"))).collect()]


def test_generic_upgrades(spark):
    wp, cdn, size, stem, folder, query, best, fmt, wiki, none, inline = generic(
        spark, "https://a/w/p-150x150.jpg", "https://a/u/w_300,h_200,c_fill/v1/p.jpg", "https://a/p=s220-c", "https://a/p_thumb.jpg", "https://a/thumbs/p.jpg", "https://a/p.jpg?w=1&id=2",
        "https://a/p.jpg?w=1&q=50", "https://a/p.jpg?format=webp", "https://u.org/wikipedia/commons/thumb/a/ab/F.jpg/220px-F.jpg?x=1", "https://a/p.jpg", "data:x",
    )
    assert wp == ["https://a/w/p.jpg"] and cdn == ["https://a/u/v1/p.jpg"] and size == ["https://a/p=s0", "https://a/p"]
    assert stem == [f"https://a/p{s}.jpg" for s in K.STEM_REPLACEMENTS]
    assert folder == [f"https://a/{d}p.jpg" for d in ("originals/", "original/", "large/", "full/", "")]
    assert query == ["https://a/p.jpg?id=2"] and best == ["https://a/p.jpg", "https://a/p.jpg?w=1&q=100"] and fmt == ["https://a/p.jpg"]
    assert wiki[0] == "https://u.org/wikipedia/commons/a/ab/F.jpg" and none == [] == inline


RULES = [
    {"match": "redd.it", "find": r"^https?://preview\.redd\.it/([^?]+).*$", "replace": "https://i.redd.it/$1"},
    {"match": "shop.com", "find": r"_(?:thumb|small|\d{2,4}x\d{0,4})(?=\.[a-z]{3,4}(?:\?|$))", "replace": "", "note": "n", "verify": False},
    {"match": "*", "path": "/never/", "find": "x", "replace": "y"},
    {"match": "*", "find": "(", "replace": "y"},
]


def test_site_rules(spark):
    df = spark.createDataFrame([(0, "https://preview.redd.it/a.jpg?w=1"), (1, "https://cdn.shop.com/p_small.jpg"), (2, "https://myshop.com/p_small.jpg")], "i int, u string").orderBy("i")
    out = [[tuple(x) for x in r[0]] for r in df.select(G.site(F.col("u"), RULES)).collect()]
    assert out == [[("https://i.redd.it/a.jpg", True, "redd.it rule")], [("https://cdn.shop.com/p.jpg", False, "n")], []]
    first = [tuple(x) for x in df.where("i = 1").select(G.candidates(F.col("u"), RULES)).first()[0]]
    assert first[0][0] == "https://cdn.shop.com/p.jpg" and len({x[0] for x in first}) == len(first)
    text = spark.createDataFrame([("a_thumb_large.jpg",)], "s string")
    assert text.select(G.replace_first(F.col("s"), "_(thumb|large)", "-$1")).first()[0] == "a-thumb_large.jpg"


def test_verification_and_collapse(spark):
    cols = "tab_id long, item long, url string, kind string, status string, bytes long, width double, height double, first_seq long, sources array<string>"
    items = spark.createDataFrame([(1, 1, "https://a/p-150x150.jpg", "image", "confirmed", 100, 150.0, 150.0, 1, ["dom"]), (1, 2, "https://a/p.jpg", "image", "background", 900, 0.0, 0.0, 2, ["net"]), (1, 3, "https://a/q_t.jpg", "image", "confirmed", 100, 1.0, 1.0, 3, ["dom"]), (1, 4, "https://a/s.m3u8", "stream", "background", None, 0.0, 0.0, 4, ["net"])], cols)
    probes = spark.createDataFrame([("https://a/p.jpg", True, 900, "image/jpeg"), ("https://a/q.jpg", True, 50, "image/jpeg"), ("https://a/q_large.jpg", True, 500, "text/html"), ("https://a/q_o.jpg", True, None, "")], "url string, ok boolean, bytes long, mime_type string")
    found = upgrades.verified(items, probes)
    assert {r.item: r.upgrade_url for r in found.collect()} == {1: "https://a/p.jpg", 2: None, 3: "https://a/q_o.jpg"}
    out = upgrades.collapse(items.join(found, ["tab_id", "item"], "left").withColumn("upgrade_verified", F.coalesce("upgrade_verified", F.lit(False))))
    got = {r.item: (r.merged_duplicates, sorted(r.sources), r.width) for r in out.collect()}
    assert got == {1: (1, ["dom", "net"], 150.0), 3: (0, ["dom"], 1.0), 4: (0, ["net"], 0.0)}


def test_policy(spark):
    base = {"tag": "button", "visible": True, "area": 900.0}
    cases = [({"text": "Load more"}, "reads as a media control"), ({"text": "Buy"}, "reads as transactional or destructive"), ({"area": 10.0}, "too small to be a control"), ({"tag": "input"}, "form control"), ({"containsMedia": True}, "wraps media — likely opens it larger")]
    cases += [({"ariaExpanded": "false"}, "opens or expands something not open yet"), ({"ariaExpanded": "true", "role": "tab"}, "no positive reason to believe it reveals media"), ({"tag": "a", "href": "/x"}, "link — queued for navigation instead"), ({"title": "poster"}, "reads as transactional or destructive"), ({"disabled": True}, "disabled")]
    fields = "tag string, visible boolean, area double, text string, title string, containsMedia boolean, ariaExpanded string, role string, href string, disabled boolean"
    names = [f.split(" ")[0] for f in fields.split(", ")]
    df = spark.createDataFrame([(i, *[(base | c).get(n) for n in names]) for i, (c, _) in enumerate(cases)], "i int, " + fields).orderBy("i")
    assert [r[0].reason for r in df.select(P.should_click(P.element(df.columns))).collect()] == [r for _, r in cases]
    page = "https://a.com/gallery/1?x=2"
    links = [("/gallery/2", "same origin"), ("https://b.com/", "different origin"), ("mailto:x@y", "not http"), ("/log%20out", "address reads as transactional or destructive"), ("/de%6Cete", "address reads as transactional or destructive"), ("", "no href"), ("https://a.com:444/", "different origin")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(links)], "i int, h string").orderBy("i")
    assert [r[0].reason for r in df.select(P.should_follow(F.col("h"), F.lit(page))).collect()] == [r for _, r in links]
    p = [r[0] for r in df.select(P.link_priority(F.col("h"), F.lit(page))).collect()]
    assert p[0] > p[1] and round(p[0], 3) == round(1 / 2 + 0.1, 3) or p[0] > 0.4


def crawl_alone(start, follow, priority, landed, clicks, max_pages, known_max):
    """One crawl as plain loops over dictionaries: the twin of a row of crawls()."""
    visited, queue, current, pages, clicked, n, trail = [start], [], start, 0, 0, 0, []
    while True:
        here, explored, found = landed.get(current, current), True, 0
        if here != current:
            explored = here not in visited
            visited += [here] * explored
        if explored:
            for key in follow.get(here, []):
                if len(visited) + len(queue) >= known_max:
                    break
                if key in visited or key in [q[2] for q in queue]:
                    continue
                n, found = n + 1, found + 1
                queue.append((-priority(key, start), n, key))
            pages, clicked = pages + 1, clicked + min(60, clicks.get(here, 0))
        trail.append((here, found, explored))
        queue.sort()
        if pages >= max_pages:
            return trail, pages, clicked, f"page limit reached ({max_pages})"
        if not queue:
            return trail, pages, clicked, "nothing left to visit"
        current = queue.pop(0)[2]
        visited.append(current)


def test_crawls(spark):
    """Many crawls in one go, each equal to the loop for it alone, with pages that answer from elsewhere and a click limit."""
    rng = random.Random(3)
    url = lambda site, i: f"https://s{site}.com/" + (f"p/{i}" + ("?page=2" if i % 4 == 0 else "") if i else "")
    rows, follow = [], {}
    for site in range(3):
        for i in range(12):
            to = [rng.randrange(14) for _ in range(rng.randint(0, 6))]
            hrefs = [url(site, j) for j in to] + ["/delete", "https://other.com/", url(site, to[0]) + "#x" if to else "/"]
            rows.append((site * 100 + i, url(site, i), "<body>" + "".join(f"<a href='{h}'>go</a>" for h in hrefs) + "</body>"))
            follow[url(site, i)] = [url(site, j) for j in to] + ([] if to else [url(site, 0)])
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = crawl.links(table)
    landed = {url(0, 5): url(0, 2), url(0, 3): url(0, 20), url(1, 1): url(1, 0)}
    clicks = {r[1]: 10 * (r[0] % 9) for r in rows}
    starts = [(site * 100 + i, url(site, i)) for site in range(3) for i in range(5)]
    pairs = [(a, b) for a in {u for v in follow.values() for u in v} for b in {s for _, s in starts}]
    rated = {(r.h, r.s): r.p for r in spark.createDataFrame(pairs, "h string, s string").select("h", "s", P.link_priority(F.col("h"), F.col("s"), {c: F.lit("go" if c == "text" else "") for c in crawl.LABELS}).alias("p")).collect()}
    pages = crawl.site(found, spark.createDataFrame(list(clicks.items()), "url string, n int"))
    done = crawl.crawls(spark.createDataFrame(starts, "crawl_id long, url string"), pages, spark.createDataFrame(list(landed.items()), "url string, landed string"), max_pages=5, known_max=9)
    got = {r.crawl_id: ([tuple(t) for t in r.trail], r.pages, r.clicks, r.note) for r in done.collect()}
    assert got == {i: crawl_alone(s, follow, lambda h, s: rated[h, s], landed, clicks, 5, 9) for i, s in starts}
    assert any(not explored for t, *_ in got.values() for *_, explored in t) and {n for *_, n in got.values()} == {"page limit reached (5)", "nothing left to visit"}
    assert crawl.trail(done).count() == sum(len(t) for t, *_ in got.values()) and crawl.status(done).where("running").count() == 0


def test_frontier(spark):
    html = lambda *hrefs: "<body>" + "".join(f"<a href='{h}'>{h}</a>" for h in hrefs) + "</body>"
    pages = spark.createDataFrame([(1, "https://a.com/", html("/p/1", "/p/2", "/delete", "https://b.com", "/p/1#x")), (2, "https://a.com/p/1", html("/", "/p/3?page=2")), (3, "https://a.com/p/2", html()), (4, "https://a.com/p/3?page=2", html("/p/1"))], "page_id long, url string, html string")
    found = crawl.links(pages)
    done = crawl.crawls(spark.createDataFrame([(1, "https://a.com/"), (2, None)], "crawl_id long, url string"), crawl.site(found))
    assert {r.key for r in crawl.trail(done).collect()} == {"https://a.com/", "https://a.com/p/1", "https://a.com/p/2", "https://a.com/p/3?page=2"} and done.first().note == "nothing left to visit"
    visited, queued = (spark.createDataFrame([(k,)], "key string") for k in ("https://a.com/p/1", "https://a.com/p/2"))
    keys = [r.key for r in crawl.frontier(crawl.accepted(found), visited, queued).collect()]
    assert set(keys) == {"https://a.com/", "https://a.com/p/3?page=2"}


def test_downloads(spark):
    items = spark.createDataFrame([(1, i, i, u, "", k, s, 0.0, 0.0, 100) for i, (u, k, s) in enumerate([("https://a/1.jpg", "image", "confirmed"), ("https://b/2.jpg?Expires=1700000100", "image", "confirmed"), ("https://a/3.mp4", "video", "protected"), ("https://a/4.m3u8", "stream", "background"), ("https://a/5.png", "image", "referenced")])], "tab_id long, item long, seq long, url string, mime_type string, kind string, status string, width double, height double, bytes long")
    jobs = downloads.plan(items, 1_700_000_000_000)
    out = {r.item: (r["index"], r.path, r.queue, r.turn, r.expiring_soon) for r in jobs.collect()}
    assert out == {0: (0, "media/a/page/001-1.jpg", 2, 1, False), 1: (1, "media/b/page/002-2.jpg", 1, 1, True), 4: (2, "media/a/page/003-5.png", 3, 2, False)}
    assert tuple(downloads.session_counts(items, jobs).first()) == (1, 3, 2, 1)
    attempts = spark.createDataFrame([(1, "a", 1, False, "CRASH"), (1, "a", 2, True, None), (1, "b", 1, False, "USER_CANCELED"), (1, "c", 1, False, "CRASH"), (1, "c", 2, False, "CRASH"), (1, "c", 3, False, "CRASH"), (1, "d", 1, False, "FILE_NO_SPACE"), (1, "d", 2, True, None)], "tab_id long, job string, seq long, ok boolean, reason string")
    states = {r.job: (r.tries, r.state) for r in downloads.fold(attempts).collect()}
    assert states == {"a": (2, "done"), "b": (1, "cancelled"), "c": (3, "failed"), "d": (1, "failed")}
    jobs = spark.createDataFrame([("s", 1, "a", 1, 1000, 0), ("s", 2, "a", 2, 1000, 0), ("s", 3, "b", 3, 500, 1)], "session string, job long, host string, queue int, duration_ms long, fails int")
    runs = {(r.job, r.attempt): (r.start_ms, r.end_ms, r.state) for r in downloads.simulate(jobs, 2).collect()}
    assert runs == {(1, 1): (0, 1000, "done"), (3, 1): (0, 500, "backoff"), (2, 1): (1000, 2000, "done"), (3, 2): (1300, 1800, "done")}


def test_verify_batch(spark):
    """Two thumbnails of one original fold into it, a checked item keeps what it had, a stream is checked and proves nothing."""
    at = "https://a.com/wp-content/"
    rows = [
        (1, 1, 1, f"{at}p-150x150.jpg", "image", "confirmed", 150.0, 150.0, 900, ["dom"], None, "", None), (1, 2, 2, f"{at}p-300x300.jpg", "image", "confirmed", 0.0, 0.0, 900, ["net"], None, "", None), (1, 3, 3, f"{at}q-150x150.jpg", "image", "confirmed", 9.0, 9.0, 10**9, ["dom"], None, "", None),
        (1, 4, 4, "https://a.com/s.m3u8", "stream", "background", 0.0, 0.0, None, ["net"], None, "", None), (1, 5, 5, f"{at}z-150x150.jpg", "image", "confirmed", 1.0, 1.0, 1, ["dom"], True, "https://old/z.jpg", True), (2, 6, 6, "data:image/png;base64,AA", "image", "confirmed", 1.0, 1.0, 1, ["dom"], None, "", None),
    ]
    items = spark.createDataFrame(rows, "tab_id long, item long, first_seq long, url string, kind string, status string, width double, height double, bytes long, sources array<string>, upgrade_checked boolean, upgrade_url string, upgrade_verified boolean")
    probes = spark.createDataFrame([(f"{at}p.jpg", True, 5000, "image/jpeg"), (f"{at}q.jpg", True, 5000, "image/jpeg"), (f"{at}z.jpg", True, 5000, "")], "url string, ok boolean, bytes long, mime_type string")
    folded, counters = upgrades.verify_batch(items, probes)
    out = {r.item: r for r in folded.collect()}
    assert set(out) == {1, 3, 4, 5, 6} and out[1].sources == ["dom", "net"] and out[1].merged_duplicates == 1 and out[1].width == 150
    assert (out[1].upgrade_checked, out[1].upgrade_verified, out[1].upgrade_url, out[1].upgrade_bytes, out[1].effective_url) == (True, True, f"{at}p.jpg", 5000, f"{at}p.jpg")
    assert [(out[i].upgrade_checked, out[i].upgrade_verified, out[i].upgrade_url, out[i].upgrade_note, out[i].upgrade_bytes) for i in (3, 4, 6)] == [(True, False, "", "", None)] * 3
    assert out[5].upgrade_url == "https://old/z.jpg" and out[5].effective_url == "https://old/z.jpg"
    assert {tuple(r) for r in counters.select("tab_id", "checked", "upgraded", "collapsed").collect()} == {(1, 4, 2, 1), (2, 1, 0, 0)}
    again, counters = upgrades.verify_batch(folded.drop("effective_url", "merged_duplicates"), probes)
    assert again.count() == 5 and {r.checked for r in counters.collect()} == {0}


def test_a_round_of_crawls_broadcasts_no_pages(spark):
    """Written tables of pages compress so well that Spark would send them all through the driver."""
    pages = spark.createDataFrame([("https://a/x", [(0, "https://a/y", "", "", "", "", "")], 0)], "page string, links array<struct<pos:int,key:string,text:string,ariaLabel:string,title:string,className:string,id:string>>, clicks long")
    state = spark.createDataFrame([], crawl.CRAWL)
    landings = spark.createDataFrame([("https://a/x", "https://a/z")], "asked string, landed string")
    plan = crawl._step(state, pages, landings, 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan

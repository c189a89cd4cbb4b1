"""Crawl planning over tables of pages and links: extraction, verdicts, priorities, a bounded frontier."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import constants as K
from lodestone.functions import policy as P
from lodestone.functions import url as U
from lodestone.functions.core import text
from lodestone.storage import written

_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the text of a tag; empty if it has none."""
    return F.concat(*(text(F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*{q}", 1)) for q in ("\"([^\"]*)\"", "'([^']*)'", r"([^\s\"'>]+)")))


def _unescape(c: Column) -> Column:
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def links(pages: DataFrame, most: int = 400) -> DataFrame:
    """page_id, url, pos, href, resolved and label fields of the anchors of each page's html: the first of each resolved
    address, in document order, at most ``most`` a page."""
    anchors = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("pos", "anchor"))
    tag = F.regexp_extract("anchor", _ANCHOR, 1)
    rows = anchors.select(
        "page_id", "url", "pos", _unescape(attribute(tag, "href")).alias("href"),
        _unescape(F.regexp_replace(F.regexp_extract("anchor", _ANCHOR, 2), "(?s)<[^>]*>", "")).alias("text"),
        *(_unescape(attribute(tag, a)).alias(n) for a, n in (("aria-label", "ariaLabel"), ("title", "title"), ("class", "className"), ("id", "id"))),
        tag.rlike(r"(?i)(?:^|\s)download(?:\s|=|\z)").alias("hasDownloadAttr"),
    ).where("href <> ''")
    rows = rows.withColumn("resolved", U.href(U.parse(F.col("href"), F.col("url"))))
    same = Window.partitionBy("page_id", "resolved").orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= most).drop("n")


def accepted(found: DataFrame, start: Column | None = None, most: int = K.MAX_LINKS) -> DataFrame:
    """Links that may be followed, with key and priority against ``start`` (default: the page itself)."""
    el = P.element(found.columns)
    verdict = P.should_follow(F.col("href"), F.col("url"), el)
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("place") <= most).drop("place")
    ok = near.where(verdict["follow"])
    return ok.withColumns({"key": U.crawl_key(F.col("href"), F.col("url")), "priority": P.link_priority(F.col("href"), start if start is not None else F.col("url"), el)})


def top_links(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best accepted links of each page: priority, then document order."""
    rank = Window.partitionBy("page_id").orderBy(F.desc("priority"), "pos")
    return accepted(found).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def judged(elements: DataFrame, key: str = "page_id", order: str = "pos", most: int = K.MAX_JUDGED) -> DataFrame:
    """click and reason of the first ``most`` controls of each page."""
    first = elements.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= most)
    return first.select("*", P.should_click(P.element(elements.columns)).alias("verdict")).select("*", "verdict.click", "verdict.reason").drop("verdict", "place")


def judge_counts(verdicts: DataFrame, key: str = "page_id", order: str = "pos") -> DataFrame:
    clicks = F.transform(F.array_sort(F.collect_list(F.when(F.col("click"), F.col(order)))), lambda x: x)
    return verdicts.groupBy(key).agg(clicks.alias("clicks"), F.count_if(~F.col("click")).alias("refused"))


#: What a link says of itself to priorities.
LABELS = ("text", "ariaLabel", "title", "className", "id")
CRAWL = (
    "crawl_id long, start string, current string, visited array<string>, queue array<struct<score:double,n:int,key:string>>, seen int, pages int, clicks long, running boolean, note string, "
    "trail array<struct<key:string,found:int,explored:boolean>>"
)


def site(found: DataFrame, clicks: DataFrame | None = None) -> DataFrame:
    """A row per page (``page``, its crawl key) with the links that may be followed, in order (key and labels), and how many
    controls were clicked (clicks: url, n), at most MAX_CLICKS a page."""
    ok = accepted(found.withColumn("page", U.crawl_key(F.col("url"), F.col("url"))))
    labels = [F.col(c) if c in found.columns else F.lit("").alias(c) for c in LABELS]
    links = ok.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "key", *labels))).alias("links"))
    if clicks is None:
        return links.withColumn("clicks", F.lit(0).cast("long"))
    counted = clicks.groupBy(U.crawl_key(F.col("url"), F.col("url")).alias("page")).agg(F.max(F.least(F.col("n"), F.lit(K.MAX_CLICKS))).cast("long").alias("clicks"))
    return links.join(counted, "page", "full").withColumn("clicks", F.coalesce("clicks", F.lit(0).cast("long")))


def _best_first(queue: Column) -> Column:
    """By priority, then by discovery."""
    by = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(x["n"] - y["n"])
    return F.array_sort(queue, by)


def _step(state: DataFrame, pages: DataFrame, landings: DataFrame | None, max_pages: int, known_max: int) -> DataFrame:
    """Every running crawl explores the page it is on and moves to the next one."""
    if landings is None:
        at = state.withColumn("here", F.col("current"))
    else:
        at = state.join(landings.hint("merge"), F.col("current") == F.col("asked"), "left").withColumn("here", F.coalesce("landed", "current")).drop("asked", "landed")
    # a navigation that ends elsewhere is explored once; on a page that was visited the crawl moves on at once
    stray = F.col("here") != F.col("current")
    at = at.withColumn("explored", ~(stray & F.array_contains("visited", F.col("here"))))
    at = at.withColumn("visited", F.when(stray & F.col("explored"), F.concat("visited", F.array("here"))).otherwise(F.col("visited")))
    on = at.join(pages.withColumnRenamed("clicks", "clicked").hint("merge"), F.col("here") == F.col("page"), "left").drop("page")
    links = F.when(F.col("explored"), F.col("links"))
    known = F.concat("visited", F.transform("queue", lambda q: q["key"]))
    keys = F.transform(links, lambda x: x["key"])
    first = F.filter(links, lambda x, i: ~F.array_contains(known, x["key"]) & (F.array_position(keys, x["key"]) == i + 1) & (x["key"] != ""))
    on = on.withColumn("fresh", F.slice(first, F.lit(1), F.greatest(F.lit(0), F.lit(known_max) - F.size(known))))
    score = lambda x: P.link_priority(x["key"], F.col("start"), {c: x[c] for c in LABELS})
    more = F.transform("fresh", lambda x, i: F.struct(score(x).alias("score"), (F.col("seen") + i + 1).alias("n"), x["key"].alias("key")))
    n_fresh = F.when(F.col("fresh").isNull(), 0).otherwise(F.size("fresh"))
    on = on.select(
        "crawl_id", "start", "here", "visited", _best_first(F.concat("queue", F.coalesce(more, F.slice("queue", F.lit(1), F.lit(0))))).alias("queue"), (F.col("seen") + n_fresh).alias("seen"),
        (F.col("pages") + F.col("explored").cast("int")).alias("pages"), (F.col("clicks") + F.when(F.col("explored"), F.coalesce("clicked", F.lit(0))).otherwise(0)).alias("clicks"),
        F.concat("trail", F.array(F.struct(F.col("here").alias("key"), n_fresh.alias("found"), F.col("explored").alias("explored")))).alias("trail"),
    )
    note = F.when(F.col("pages") >= max_pages, f"page limit reached ({max_pages})").when(F.size("queue") == 0, "nothing left to visit").otherwise("")
    on = on.withColumns({"note": note, "next": F.get("queue", F.lit(0))["key"]})
    running = F.col("note") == ""
    return on.select(
        "crawl_id", "start", F.when(running, F.col("next")).otherwise(F.col("here")).alias("current"), F.when(running, F.concat("visited", F.array("next"))).otherwise(F.col("visited")).alias("visited"),
        F.when(running, F.slice("queue", F.lit(2), F.greatest(F.size("queue") - 1, F.lit(0)))).otherwise(F.col("queue")).alias("queue"), "seen", "pages", "clicks", running.alias("running"), "note", "trail",
    )


def crawls(starts: DataFrame, pages: DataFrame, landings: DataFrame | None = None, max_pages: int = K.MAX_PAGES, known_max: int = K.MAX_KNOWN_PAGES) -> DataFrame:
    """CRAWL rows: what the crawls of ``starts`` (crawl_id, url) visit over site() pages, all of them side by side.

    A round explores one page of every crawl that still runs: a join of their current pages with the table of pages, so no
    crawl and no page comes to the driver and the pages of a large site are spread like any others. Rounds end when no crawl
    runs, after at most ``known_max`` of them. landings (url, landed): addresses that answer from elsewhere.
    """
    key = U.crawl_key(F.col("url"), F.col("url"))
    pages = written(pages.where("page is not null").select("page", "links", "clicks"))
    if landings is not None:
        landings = written(landings.select(key.alias("asked"), U.crawl_key(F.col("landed"), F.col("landed")).alias("landed")).where("asked <> '' and landed <> ''").dropDuplicates(["asked"]))
    none = {"visited": F.array("start"), "seen": F.lit(0), "pages": F.lit(0), "clicks": F.lit(0).cast("long"), "running": F.lit(True), "note": F.lit("")}
    state = starts.select(F.col("crawl_id").cast("long").alias("crawl_id"), key.alias("start")).where("start <> ''")
    types = {f.name: f.dataType for f in T._parse_datatype_string(CRAWL).fields}
    state = state.withColumns({"current": F.col("start"), "queue": F.array().cast(types["queue"]), "trail": F.array().cast(types["trail"])} | none)
    state = written(state.select(*(F.col(n).cast(t).alias(n) for n, t in types.items())))
    ended = []
    for _ in range(known_max + 1):
        state = written(_step(state, pages, landings, max_pages, known_max).select(*(F.col(n).cast(t).alias(n) for n, t in types.items())))
        ended.append(state.where("not running"))
        state = state.where("running")
        if not state.take(1):
            break
    return functools.reduce(DataFrame.unionByName, ended)


def trail(done: DataFrame) -> DataFrame:
    """A row per page that a crawl came to: crawl_id, place, key, found (links newly queued), explored."""
    return done.select("crawl_id", F.posexplode("trail").alias("place", "t")).select("crawl_id", "place", "t.*")


def frontier(found: DataFrame, visited: DataFrame, queued: DataFrame) -> DataFrame:
    """Accepted links neither visited nor queued (key), each once, best first."""
    fresh = found.join(visited.select("key"), "key", "left_anti").join(queued.select("key"), "key", "left_anti")
    return fresh.groupBy("key").agg(F.max("priority").alias("priority"), F.min("pos").alias("pos")).orderBy(F.desc("priority"), "pos")


def status(done: DataFrame, limit: int = K.MAX_PAGES) -> DataFrame:
    """What a crawl tells of itself, from CRAWL rows."""
    return done.select("crawl_id", "running", "pages", "clicks", F.size("queue").alias("queued"), F.col("current").alias("current_url"), "note", F.lit(limit).alias("limit"))

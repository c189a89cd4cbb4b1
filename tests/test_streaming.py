import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import downloads as streams
from lodestone.streaming import tabs, upsert

SCHEMA = "tab_id long, seq long, type string, url string, kind string, source string, status string, navigation boolean, crawling boolean"
EVENTS = [
    (1, 1, "nav_begin", None, None, None, False, False), (1, 2, "candidate", "a.mp4", "video", "dom", False, False), (1, 3, "page_info", "p1", None, None, True, False),
    (1, 4, "candidate", "b.jpg", "image", "net", False, False), (1, 5, "eme", None, None, None, False, False), (1, 6, "nav_begin", None, None, None, False, False), (1, 7, "candidate", "c.jpg", "image", "dom", False, False),
    (1, 8, "page_info", "p2", None, None, True, False), (1, 9, "candidate", "c.jpg", "image", "net", False, False), (1, 10, "nav_begin", None, None, None, False, False), (1, 11, "nav_complete", "p3", None, None, False, True),
    (1, 12, "nav_complete", "p3", None, None, False, False), (2, 1, "candidate", "z.mp4", "video", "dom", False, False), (2, 2, "eme", None, None, None, False, False), (2, 3, "tab_closed", None, None, None, False, False),
]
COLUMNS = [x.split(" ")[0] for x in tabs.ITEM.split(", ")]


def key(rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A stream of tab events that a test writes file by file, and all rows that came out of it."""

    def __init__(self, spark, folder, make, schema=SCHEMA, interval="0 seconds"):
        self.spark, self.folder, self.n, self.rows, self.schema = spark, folder, 0, [], schema
        (folder / "in").mkdir()
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        self.query = make(source).writeStream.outputMode("update").option("checkpointLocation", str(folder / "cp")).trigger(processingTime=interval).foreachBatch(lambda df, _: self.rows.extend(df.collect())).start()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / f"w{self.n}"))
        part = next((self.folder / f"w{self.n}").glob("part-*"))
        part.rename(self.folder / "in" / f"{self.n:03}.parquet")
        self.n += 1

    def until(self, done, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not done(self.rows):
            if self.query.exception():
                raise self.query.exception()
            time.sleep(0.1)
        assert done(self.rows), self.rows


def event(tab, seq, kind, url=None, navigation=False, crawling=False, media="image", source="dom"):
    return (tab, seq, kind, url, media, source, "", navigation, crawling)


def test_batch(spark):
    df = spark.createDataFrame([(*e[:6], "", *e[6:]) for e in EVENTS], SCHEMA)
    rows = tabs.batch(df)
    got = [tuple(r)[1:] for r in rows.where("tab_id = 1").orderBy("seq").collect()]
    assert (8, "a.mp4", 1, "history", "protected", "navigation") in got and (9, "c.jpg", 2, "live", "confirmed", "seen") in got and (12, "c.jpg", 2, "history", "confirmed", "orphaned") in got
    assert not [x for x in got if x[0] == 11] and tabs.current(rows).count() == 0 and tabs.history(rows).where("tab_id = 1").count() == 3
    assert [r.gen for r in tabs.generations(df).where("tab_id = 1 and type = 'candidate'").orderBy("seq").collect()] == [1, 1, 2, 2]
    assert tabs.batch(df.limit(0)).collect() == []


def test_stream_gives_the_rows_of_batch(rocks, tmp_path):
    """Cut into three micro-batches; loads settle at once, as in a log (whether a crawl runs is asked when a timer ends, so the
    load of seq 11 is left out). The table holds the last row of each key."""
    df = rocks.createDataFrame([(*e[:6], "", *e[6:]) for e in EVENTS if e[1] != 11], SCHEMA)
    for i, (low, high) in enumerate([(0, 5), (5, 9), (9, 99)]):
        df.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []

    def put(rows, number):
        new = rows.persist().collect()
        upsert.write(rows, number, str(tmp_path / "out"), ["tab_id", "url"], "seq")
        seen.extend(new)

    query = tabs.stream(source, grace_ms=0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").foreachBatch(put).start()
    end = time.time() + 90
    want = key(tabs.batch(df).collect())
    while time.time() < end and len(seen) < len(want) and not query.exception():
        time.sleep(0.2)
    query.stop()
    assert key(seen) == want
    last = {}
    for r in sorted(seen, key=lambda r: r.seq):
        last[r.tab_id, r.url] = r.state
    table = upsert.table(rocks, str(tmp_path / "out"), tabs.ITEM).collect()
    assert {(r.tab_id, r.url): r.state for r in table} == last and len(table) == len(last)


def test_grace_of_a_finished_load(rocks, tmp_path):
    """Tab 1 never reports and is orphaned by the timer; tab 2 reports late, but within the grace period; tab 3 is crawling;
    tab 4 is closed before its timer ends. History comes back from the list state."""
    feed = Feed(rocks, tmp_path, lambda s: tabs.stream(s, grace_ms=6000))
    try:
        feed.put([x for t in (1, 2, 3, 4) for x in (event(t, 1, "page_info", f"https://a/{t}", True), event(t, 2, "candidate", f"https://a/{t}.jpg"), event(t, 3, "nav_begin"))])
        feed.until(lambda rows: len(rows) == 4)
        feed.put([event(t, 4, "nav_complete", f"https://b/{t}.pdf", crawling=t == 3) for t in (1, 2, 3, 4)])
        feed.put([event(2, 5, "page_info", "https://b/2.pdf", True), event(4, 5, "tab_closed")])
        feed.until(lambda rows: any(r.reason == "orphaned" for r in rows))
        feed.put([event(t, 6, "recall") for t in (1, 2, 3, 4)])
        feed.until(lambda rows: sum(r.state == "recalled" for r in rows) == 2)
        time.sleep(1)
    finally:
        feed.query.stop()
    gone = {(r.tab_id, r.seq, r.state, r.reason) for r in feed.rows if r.state in ("history", "dropped")}
    assert gone == {(1, 4, "history", "orphaned"), (2, 5, "history", "navigation"), (4, 5, "dropped", "closed")}
    assert {(r.tab_id, r.url, r.reason) for r in feed.rows if r.state == "recalled"} == {(1, "https://a/1.jpg", "orphaned"), (2, "https://a/2.jpg", "navigation")}


def test_store_touches_only_the_keys_of_its_events():
    """A candidate among a thousand items reads and writes one entry of the map."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Map:
        def __init__(self):
            self.entries, self.touched = {}, []

        def containsKey(self, k):
            self.touched.append(k)
            return k in self.entries

        def getValue(self, k):
            self.touched.append(k)
            return self.entries[k]

        def updateValue(self, k, v):
            self.touched.append(k)
            self.entries[k] = v

        def iterator(self):
            raise AssertionError("all entries were read")

    tab, items = Value(), Map()
    rows = [type("E", (), dict(zip(SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", "), event(1, i, "candidate", f"https://a/{i}.jpg"))))() for i in range(1000)]
    store = tabs._Kept(tab, items, None)
    for row in rows:
        tabs.apply(store, row)
    store.flush()
    items.touched.clear()
    store = tabs._Kept(tab, items, None)
    rows[7].seq, rows[7].source = 2000, "net"
    assert tabs.apply(store, rows[7]) == [(2000, "https://a/7.jpg", 0, "live", "confirmed", "seen")]
    store.flush()
    assert set(items.touched) == {("https://a/7.jpg",)} and len(items.entries) == 1000 and store.tab["items"] == 1000


def test_upsert_repeats_and_kills(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, seq long, v string")
    assert upsert.table(spark, path, "k long, seq long, v string").collect() == []
    assert upsert.write(frame([(i, 1, "a") for i in range(50)] + [(3, 2, "b"), (3, 0, "z")]), 0, path, ["k"], "seq", 4)
    assert not upsert.write(frame([(3, 9, "again")]), 0, path, ["k"], "seq", 4)
    # a batch that dies between its data and its manifest is not seen, and its repetition leaves one row per key
    real = spark.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None: (_ for _ in ()).throw(RuntimeError("killed")) if schema == upsert.MANIFEST else real(rows, schema))
        with pytest.raises(RuntimeError):
            upsert.write(frame([(3, 5, "c"), (77, 5, "new")]), 1, path, ["k"], "seq", 4)
    got = lambda: {r.k: r.v for r in upsert.table(spark, path, "k long, seq long, v string").collect()}
    assert got()[3] == "b" and 77 not in got()
    for _ in range(2):
        upsert.write(frame([(3, 5, "c"), (77, 5, "new"), (4, 0, "older")]), 1, path, ["k"], "seq", 4)
    rows = upsert.table(spark, path, "k long, seq long, v string").collect()
    assert len(rows) == 51 and got()[3] == "c" and got()[77] == "new" and got()[4] == "a"
    assert upsert.write(frame([]), 2, path, ["k"], "seq", 4) and len(got()) == 51


def test_progress(rocks, tmp_path):
    """Seven jobs of a session over three micro-batches, and another that ends at once: errors stay in order, the last five
    are kept, and the report goes out once."""
    feed = Feed(rocks, tmp_path, streams.progress, streams.EVENT)
    try:
        feed.put([("a", i, i, "queued", None) for i in range(7)] + [("b", 1, 0, "queued", None), ("b", 2, 0, "cancelled", None)])
        feed.until(lambda rows: len(rows) == 2)
        feed.put([("a", 10 + i, i, "running", None) for i in range(7)] + [("a", 20 + k, i, "failed", f"E{i}") for k, i in enumerate((3, 1, 5, 0, 2, 6))])
        feed.until(lambda rows: len(rows) == 3)
        feed.put([("a", 40, 4, "done", ""), ("c", 1, 9, "strange", None)])
        feed.until(lambda rows: len(rows) == 5)
        feed.put([("a", 50, 4, "done", "")])
        feed.until(lambda rows: len(rows) == 6)
    finally:
        feed.query.stop()
    a = [r for r in feed.rows if r.session == "a"]
    assert [(r.total, r.done, r.failed, r.running, r.pending, r.percent, r.finished) for r in a] == [(7, 0, 0, 0, 7, 0, False), (7, 0, 6, 1, 1, 86, False), (7, 1, 6, 0, 0, 100, True), (7, 1, 6, 0, 0, 100, True)]
    assert a[1].errors == a[2].errors == ["E1", "E5", "E0", "E2", "E6"] and [r.report is not None for r in a] == [False, False, True, False]
    assert [(x["job"], x["state"]) for x in json.loads(a[2].report)] == [(i, "done" if i == 4 else "failed") for i in range(7)]
    assert [(r.cancelled, r.finished, r.report is not None) for r in feed.rows if r.session == "b"] == [(1, True, True)]
    assert [(r.total, r.finished) for r in feed.rows if r.session == "c"] == [(0, False)]


def test_jobs_are_lost_only_once_the_watermark_has_passed(spark, tmp_path):
    """Job 2's state comes late but in time; job 3 is lost when its time has passed; job 4's state comes after that."""
    jobs, states = "session string, job long, download_id long, tries int, state string, error string, found_at timestamp", "download_id long, state string, error string, told_at timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for side in ("j", "s"):
        (tmp_path / side / "in").mkdir(parents=True)
    left = spark.readStream.schema(jobs).parquet(str(tmp_path / "j" / "in"))
    right = spark.readStream.schema(states).parquet(str(tmp_path / "s" / "in"))
    out = []
    query = streams.resumed(left, right).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).start()

    def put(side, schema, rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / side / name))
        next((tmp_path / side / name).glob("part-*")).rename(tmp_path / side / "in" / f"{name}.parquet")
        query.processAllAvailable()

    try:
        put("j", jobs, [("s", i, i, 1, "running", "", at(0)) for i in (1, 2, 3, 4)] + [("s", 5, None, 0, "queued", "", at(0)), ("s", 6, 6, 3, "running", "", at(0))], "a")
        put("s", states, [(1, "complete", None, at(1)), (6, "interrupted", "CRASH", at(1))], "a")
        assert {r.job for r in out} == {1, 5, 6}
        put("s", states, [(2, "in_progress", None, at(9)), (77, "complete", None, at(9))], "b")
        put("j", jobs, [("s", 8, 8, 1, "running", "", at(9))], "b")
        assert {r.job for r in out} == {1, 2, 5, 6}
        put("j", jobs, [("s", 9, 9, 1, "running", "", at(30))], "c")
        put("s", states, [(99, "complete", None, at(30))], "c")
        put("s", states, [(4, "complete", None, at(5))], "d")
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.job: (r.state, r.error) for r in out}
    assert len(out) == len(got) and 9 not in got
    assert got == {1: ("done", ""), 2: ("running", ""), 3: ("backoff", "NETWORK_FAILED"), 4: ("backoff", "NETWORK_FAILED"), 5: ("queued", ""), 6: ("failed", "CRASH"), 8: ("backoff", "NETWORK_FAILED")}

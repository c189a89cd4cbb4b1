"""Tab state from an event log, in batch and as a stream: generations, retirement, history, protection.

Events are rows (tab_id, seq, type, url, kind, source, status, navigation, crawling). Types: nav_begin, page_info
(``navigation`` true for the message of a new document), page_reset, clear, nav_complete, candidate, eme, mse, recall,
tab_closed. Events of a tab apply in the order of seq; tabs are independent; a candidate is known by its dedupe key.

The stream keeps a tab's state in parts: one value for the tab, a map of live items by dedupe key, a list of history rows,
and the loads whose grace period runs. An event reads and writes the entries it concerns; only what retires all items, or
protects them, visits all. The rules work on a Store, so that batch and stream cannot differ.

A finished load waits ORPHAN_GRACE_MS for the page's own report. In the stream that is a processing-time timer; a log has no
clock, so there a load is settled where its event stands.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone import constants as K
from lodestone.functions import url as U
from lodestone.streaming import upsert

EVENT = "tab_id long, seq long, type string, url string, kind string, source string, status string, navigation boolean, crawling boolean"
ITEM = "tab_id long, seq long, url string, gen long, state string, status string, reason string"
AV = ("video", "audio", "stream")

TAB = "gen long, pending long, page string, eme boolean, mse boolean, crawling boolean, items long, history long"
LIVE = "gen long, kind string, status string, sources array<string>"
PAST = "seq long, url string, gen long, status string, reason string"
LOAD = "seq long, url string"
FRESH = (0, None, "", False, False, False, 0, 0)

#: An output row without its tab: (seq, url, gen, state, status, reason).
Row = tuple


class Store:
    """A tab's state in memory."""

    def __init__(self):
        self.tab = dict(zip(_names(TAB), FRESH, strict=True))
        self.live: dict[str, list] = {}
        self.past: list[tuple] = []

    def get(self, url: str) -> list | None:
        return self.live.get(url)

    def put(self, url: str, item: list) -> None:
        self.live[url] = item

    def remove(self, url: str) -> None:
        del self.live[url]

    def all(self) -> list[tuple[str, list]]:
        return list(self.live.items())

    def remember(self, rows: list[tuple]) -> None:
        self.past = (self.past + rows)[-K.MAX_HISTORY :]

    def recall(self) -> list[tuple]:
        return self.past

    def forget(self) -> None:
        self.past = []

    def reset(self) -> None:
        """As if the tab had never been seen."""
        self.__init__()


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


# ---------------------------------------------------------------- the rules


def _retire(store: Store, seq: int, reason: str, before: float = float("inf"), keep: bool = True) -> list[Row]:
    """Items of generations before ``before`` leave the index, to history if that is kept."""
    gone = [(url, item) for url, item in store.all() if item[0] < before]
    for url, _ in gone:
        store.remove(url)
    store.tab["items"] -= len(gone)
    if keep:
        store.remember([(seq, url, gen, status, reason) for url, (gen, _, status, _) in gone])
    else:
        store.forget()
    return [(seq, url, gen, "history" if keep else "dropped", status, reason) for url, (gen, _, status, _) in gone]


def settle(store: Store, seq: int, url: str, keep_history: bool = True) -> list[Row]:
    """A load is over: nothing was pending, or the page has reported or never changed, or nothing could report from it."""
    tab = store.tab
    if tab["pending"] is None:
        return []
    if not (url and tab["page"] and url != tab["page"]):
        tab["pending"] = None
        return []
    if tab["crawling"]:
        return []
    out = _retire(store, seq, "orphaned", keep=keep_history)
    tab.update(eme=False, mse=False, pending=None, page=url)
    return out


def _candidate(store: Store, event) -> list[Row]:
    tab, url, seq = store.tab, event.url, int(event.seq)
    item = store.get(url)
    if item is None:
        if tab["items"] >= K.MAX_ITEMS_PER_TAB:
            return [(seq, url, tab["gen"], "refused", event.status or "", "truncated")]
        tab["items"] += 1
        item = [0, event.kind or "", event.status or "referenced", []]
    gen, kind, status, sources = tab["gen"], item[1], item[2], item[3]
    if event.source and event.source not in sources:
        sources = [*sources, event.source]
    if tab["eme"] and kind in AV:
        status = "protected"
    elif "dom" in sources and len(sources) > 1 and status != "protected":
        status = "confirmed"
    store.put(url, [gen, kind, status, sources])
    return [(seq, url, gen, "live", status, "seen")]


def apply(store: Store, event, keep_history: bool = True, settle_now: bool = True) -> list[Row]:
    """Changes ``store`` by one event and returns output rows."""
    tab, seq, url = store.tab, int(event.seq), event.url or ""
    crawling = tab["crawling"] = bool(event.crawling)
    if event.type == "candidate":
        return _candidate(store, event) if url else []
    if event.type == "nav_begin":
        tab["gen"] += 1
        tab["pending"] = tab["gen"]
    elif event.type in ("page_info", "page_reset"):
        out = []
        if event.type == "page_reset" and not crawling:  # a new route: the player and its protection persist
            out = _retire(store, seq, "route", keep=keep_history)
            tab["pending"] = None
        elif event.type == "page_info" and event.navigation and not crawling:
            out = _retire(store, seq, "navigation", float("inf") if tab["pending"] is None else tab["pending"], keep_history)
            tab.update(eme=False, mse=False, pending=None)
        tab["page"] = url or tab["page"]
        return out
    elif event.type == "nav_complete":
        return settle(store, seq, url, keep_history) if settle_now else []
    elif event.type == "clear":
        out = _retire(store, seq, "clear", keep=False)
        tab.update(eme=False, mse=False, pending=None)
        return out
    elif event.type == "mse":
        tab["mse"] = True
    elif event.type == "eme":
        tab["eme"] = True
        locked = [(address, item) for address, item in store.all() if item[1] in AV and item[2] != "protected"]
        for address, (gen, kind, _, sources) in locked:
            store.put(address, [gen, kind, "protected", sources])
        return [(seq, address, item[0], "live", "protected", "eme") for address, item in locked]
    elif event.type == "recall":
        return [(seq, address, gen, "recalled", status, reason) for _, address, gen, status, reason in store.recall()]
    elif event.type == "tab_closed":
        out = _retire(store, seq, "closed", keep=False)
        store.reset()
        return out
    return []


#: Rows that Python holds as objects, of input and of output.
ROWS = 4096
_Event = namedtuple("_Event", _names(EVENT))
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _item_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ITEM.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _frame(tab: int, rows: list[Row]) -> pd.DataFrame:
    return pd.DataFrame([(tab, *r) for r in rows], columns=_names(ITEM))


def _typed(events: DataFrame) -> DataFrame:
    fields = [x.split(" ") for x in EVENT.split(", ")]
    rows = events.select(*(F.col(n).cast(t).alias(n) if n in events.columns else F.lit(None).cast(t).alias(n) for n, t in fields))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("navigation", "crawling")}
    return rows.withColumns({"url": F.when(F.col("type") == "candidate", U.normalize_url(F.col("url"))).otherwise(F.col("url")), **flags})


def _events(frame: pd.DataFrame):
    """The rows of a frame as plain values, in order."""
    frame = frame.sort_values("seq").astype(object)
    return frame.where(frame.notna(), None).itertuples(index=False)


def batch(events: DataFrame, keep_history: bool = True) -> DataFrame:
    """All output rows of an event log. Spark brings a tab's events together in order; they are read as they come, and only the
    tab's state is kept, so that a tab may be of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, tab, out = Store(), None, []
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for values in zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True):
                    event = _Event(*values)
                    if event.tab_id != tab:
                        store, tab = Store(), event.tab_id
                    out += [(tab, *r) for r in apply(store, event, keep_history)]
                    if len(out) >= ROWS:
                        yield _item_batch(out)
                        out = []
        if out:
            yield _item_batch(out)

    return _typed(events).repartition("tab_id").sortWithinPartitions("tab_id", F.asc_nulls_last("seq")).mapInArrow(run, ITEM)


# ---------------------------------------------------------------- the stream


class _Kept(Store):
    """A tab's state in the state store. What one call reads stays at hand until it ends; what it changed is written then."""

    def __init__(self, tab, items, past):
        self._tab, self._items, self._past = tab, items, past
        self.tab = dict(zip(_names(TAB), tab.get() if tab.exists() else FRESH, strict=True))
        self._seen: dict[str, list | None] = {}
        self._changed: set[str] = set()
        self._before = dict(self.tab)

    def get(self, url):
        if url not in self._seen:
            self._seen[url] = self._load(self._items.getValue((url,))) if self._items.containsKey((url,)) else None
        return self._seen[url]

    @staticmethod
    def _load(value) -> list:
        return [value[0], value[1], value[2], list(value[3])]

    def put(self, url, item):
        self._seen[url] = item
        self._changed.add(url)

    def remove(self, url):
        self.put(url, None)

    def all(self):
        for (url,), value in self._items.iterator():
            self._seen.setdefault(url, self._load(value))
        return [(url, item) for url, item in self._seen.items() if item is not None]

    def remember(self, rows):
        if not rows:
            return
        self._past.appendList(rows)
        self.tab["history"] += len(rows)
        if self.tab["history"] >= 2 * K.MAX_HISTORY:  # cut from time to time, so that a row is written twice at most
            self._past.put(self.recall())
            self.tab["history"] = K.MAX_HISTORY

    def recall(self):
        return [tuple(x) for x in self._past.get()][-K.MAX_HISTORY :] if self.tab["history"] else []

    def forget(self):
        if self.tab["history"]:
            self._past.clear()
            self.tab["history"] = 0

    def reset(self):
        self._items.clear()
        self.forget()
        self._seen, self._changed = {}, set()
        self.tab.update(zip(_names(TAB), FRESH, strict=True))

    def flush(self) -> None:
        for url in self._changed:
            item = self._seen[url]
            if item is not None:
                self._items.updateValue((url,), tuple(item))
            elif self._items.containsKey((url,)):
                self._items.removeKey((url,))
        now = tuple(self.tab.values())
        if now == FRESH:
            self._tab.clear()
        elif self.tab != self._before or not self._tab.exists():
            self._tab.update(now)


class TabProcessor(StatefulProcessor):
    """The rules over state variables, with a timer for each finished load. ``idle_ms``: entries that nothing has written for
    so long go by themselves, for tabs whose closing was never seen."""

    def __init__(self, keep_history: bool = True, grace_ms: int = K.ORPHAN_GRACE_MS, idle_ms: int | None = None):
        self.keep_history, self.grace_ms, self.idle_ms = keep_history, grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tab = handle.getValueState("tab", TAB, self.idle_ms)
        self.items = handle.getMapState("items", "url string", LIVE, self.idle_ms)
        self.past = handle.getListState("past", PAST, self.idle_ms)
        self.loads = handle.getMapState("loads", "due long", LOAD, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        store, out = _Kept(self.tab, self.items, self.past), []
        due = timerValues.getCurrentProcessingTimeInMs() + self.grace_ms
        for event in _events(pd.concat(list(rows))):
            out += apply(store, event, self.keep_history, settle_now=False)
            # of loads that end at the same time the first one decides: after it nothing is pending
            if event.type == "nav_complete" and not self.loads.containsKey((due,)):
                self.loads.updateValue((due,), (int(event.seq), event.url or ""))
                self.handle.registerTimer(due)
            elif event.type == "tab_closed":
                for (at,), _ in list(self.loads.iterator()):
                    self.handle.deleteTimer(at)
                self.loads.clear()
        store.flush()
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        out = []
        if self.loads.containsKey(at):
            seq, url = self.loads.getValue(at)
            self.loads.removeKey(at)
            store = _Kept(self.tab, self.items, self.past)
            out = settle(store, seq, url, self.keep_history)
            store.flush()
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def stream(events: DataFrame, keep_history: bool = True, grace_ms: int = K.ORPHAN_GRACE_MS, idle_ms: int | None = None) -> DataFrame:
    """The rows of batch() as a stream, loads settled after their grace period; events must arrive in order of seq across
    micro-batches of a tab. Needs the RocksDB state store."""
    return _typed(events).groupBy("tab_id").transformWithStateInPandas(TabProcessor(keep_history, grace_ms, idle_ms), ITEM, "Update", "ProcessingTime")


def generations(events: DataFrame) -> DataFrame:
    """Each event's generation, the navigations begun so far in its tab: a window, no state."""
    so_far = Window.partitionBy("tab_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("gen", F.sum(F.when(F.col("type") == "nav_begin", 1).otherwise(0)).over(so_far))


def current(items: DataFrame) -> DataFrame:
    """The last row of each (tab_id, url) that is live."""
    last = items.groupBy("tab_id", "url").agg(F.max_by(F.struct("gen", "state", "status"), F.struct("seq", (F.col("state") == "live").cast("int"))).alias("x"))
    return last.select("tab_id", "url", "x.*").where("state = 'live'")


def history(items: DataFrame, most: int = K.MAX_HISTORY) -> DataFrame:
    """Of each tab the last ``most`` rows that went to history, in order."""
    place = F.row_number().over(Window.partitionBy("tab_id").orderBy(F.desc("seq"), F.desc("url")))
    return items.where("state = 'history'").withColumn("place", place).where(F.col("place") <= most).drop("place")


def started(out: DataFrame, path: str, checkpoint: str, interval: str = "250 milliseconds"):
    """Writes a stream's rows through to a table of the last row per (tab_id, url), see upsert."""
    return upsert.started(out, path, checkpoint, ["tab_id", "url"], "seq", interval)


def pruned(states: DataFrame, open_tabs: DataFrame) -> DataFrame:
    """Rows of tabs that are still open."""
    return states.join(open_tabs.select("tab_id").distinct(), "tab_id", "left_semi")

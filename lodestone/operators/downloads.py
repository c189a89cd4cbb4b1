"""Download planning: jobs in order of expiry, one at a time per host, retries, outcomes, reports. Nothing is fetched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import paths as X
from lodestone.functions import url as U
from lodestone.functions.core import text
from lodestone.operators.index import downloadable
from lodestone.operators.upgrades import effective_url


def plan(items: DataFrame, now_ms: int, session: str = "tab_id", template: str = X.TEMPLATE, use_upgrades: bool = True) -> DataFrame:
    """A job per downloadable item: its URL, index (from 0, in input order), host, path, expiry and place in the queue."""
    rows = downloadable(items)
    rows = effective_url(rows) if use_upgrades and "upgrade_verified" in items.columns else rows.withColumn("effective_url", F.col("url"))
    order, all_ = Window.partitionBy(session).orderBy("seq"), Window.partitionBy(session)
    rows = rows.withColumns({"index": F.row_number().over(order) - 1, "total": F.count("*").over(all_)})
    col = lambda c: F.col(c) if c in rows.columns else F.lit("")
    values = X.tokens(F.col("effective_url"), F.col("mime_type"), F.col("width"), F.col("height"), F.col("index") + 1, F.col("total"), col("page_url"), col("page_title"), col("group_label"), F.timestamp_millis(F.lit(now_ms)))
    rows = rows.withColumn("x", U.expiry(F.col("effective_url"), F.lit(now_ms)))
    soon = F.col("x.expiring") & (F.col("x.expires_at").isNull() | (F.col("x.expires_at") - now_ms < K.EXPIRY_WARN_MS))
    rows = rows.select("*", U.host_of(F.col("effective_url")).alias("host"), X.apply_template(values, template).alias("path"), F.col("x.expires_at").alias("expires_at"), soon.alias("expiring_soon")).drop("x")
    queue = [F.col("expires_at").asc_nulls_last(), F.col("index")]
    return rows.withColumns({"queue": F.row_number().over(Window.partitionBy(session).orderBy(*queue)), "turn": F.row_number().over(Window.partitionBy(session, "host").orderBy(*queue))})


def session_counts(items: DataFrame, jobs: DataFrame, session: str = "tab_id") -> DataFrame:
    """Per session: total jobs, skipped items, jobs expiring soon."""
    a = items.groupBy(session).agg(F.count("*").alias("items"))
    b = jobs.groupBy(session).agg(F.count("*").alias("total"), F.count_if("expiring_soon").alias("expiring_soon"))
    out = a.join(b, session, "left").select(session, F.coalesce("total", F.lit(0)).alias("total"), "items", F.coalesce("expiring_soon", F.lit(0)).alias("expiring_soon"))
    return out.select(session, "total", (F.col("items") - F.col("total")).alias("skipped"), "expiring_soon")


def route(url: Column, har_body: Column, synthetic: tuple[str, ...] = ()) -> Column:
    """Where an item's bytes come from: a HAR body in hand, the URL itself, a capture, or the network."""
    out = F.when(F.coalesce(har_body, F.lit(False)), "har").when(url.startswith("data:"), "inline")
    for scheme in synthetic:
        out = out.when(url.startswith(f"{scheme}:"), "capture")
    return out.otherwise("network")


def retry_delay(tries: Column, status: Column, retry_after_s: Column) -> Column:
    """Milliseconds until the next try, null if the file is gone. Other answers to a probe are advisory."""
    delay = F.least(F.lit(float(K.BACKOFF_MAX_MS)), K.BACKOFF_BASE_MS * F.pow(F.lit(2.0), tries - 1))
    asked = F.least(F.lit(float(K.BACKOFF_MAX_MS)), retry_after_s * 1000.0)
    busy = F.when(retry_after_s > 0, asked).otherwise(F.least(F.lit(float(K.BACKOFF_MAX_MS)), delay * 2))
    return F.when(status.isin(404, 410), None).when(status.isin(429, 503), busy).otherwise(delay).cast("long")


def outcome(ok: Column, reason: Column, tries: Column, stopped: Column | None = None) -> Column:
    """The state of a job after an attempt: done, cancelled, backoff or failed."""
    stopped = F.lit(False) if stopped is None else stopped
    again = F.coalesce(reason.isin(K.RETRYABLE), F.lit(False)) & (tries < K.DOWNLOAD_TRIES)
    return F.when(ok, "done").when(stopped | (text(reason) == "USER_CANCELED"), "cancelled").when(again, "backoff").otherwise("failed")


def fold(attempts: DataFrame, session: str = "tab_id") -> DataFrame:
    """The state of each job from its attempts (session, job, seq, ok, reason): later attempts follow only a backoff."""
    order = Window.partitionBy(session, "job").orderBy("seq")
    rows = attempts.withColumn("tries", F.row_number().over(order))
    rows = rows.withColumn("state", outcome(F.col("ok"), F.col("reason"), F.col("tries")))
    ended = F.min(F.when(F.col("state") != "backoff", F.col("tries"))).over(Window.partitionBy(session, "job"))
    rows = rows.withColumn("end", ended).where(F.col("end").isNull() | (F.col("tries") <= F.col("end")))
    error = F.when(F.col("ok"), "").otherwise(F.when(text(F.col("reason")) == "", "unknown error").otherwise(F.col("reason")))
    return rows.groupBy(session, "job").agg(F.max("tries").alias("tries"), F.max_by("state", "tries").alias("state"), F.max_by(error, "tries").alias("error"))


def progress(jobs: DataFrame, session: str = "tab_id") -> DataFrame:
    """Counters of a session and whether it is finished; percent is rounded half up."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    out = jobs.groupBy(session).agg(F.count("*").alias("total"), n("done").alias("done"), n("failed").alias("failed"), n("running").alias("running"), n("cancelled").alias("cancelled"), n("queued", "running", "backoff").alias("pending"))
    return out.withColumns({"percent": F.floor((F.col("done") + F.col("failed")) / F.col("total") * 100 + 0.5).cast("long"), "finished": F.col("pending") == 0})


def recent_errors(jobs: DataFrame, session: str = "tab_id", most: int = 5) -> DataFrame:
    """The last failures of each session, in order."""
    last = Window.partitionBy(session).orderBy(F.desc("seq"))
    return jobs.where("state = 'failed'").withColumn("place", F.row_number().over(last)).where(F.col("place") <= most).orderBy(session, "seq").drop("place")


def stopped(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("state", F.when(F.col("state").isin("queued", "backoff"), "cancelled").otherwise(F.col("state")))


def resumed(jobs: DataFrame, downloads: DataFrame) -> DataFrame:
    """Jobs after a restart, from what is known of their downloads (download_id, state, error): unknown ones count as lost."""
    known = downloads.select("download_id", F.col("state").alias("now"), F.col("error").alias("why"))
    rows = jobs.join(known, "download_id", "left")
    running = F.col("state") == "running"
    state = F.when(~running, F.col("state")).when(F.col("now") == "complete", "done").when(F.col("now") == "in_progress", "running").otherwise(outcome(F.lit(False), F.coalesce("why", F.lit("NETWORK_FAILED")), F.col("tries")))
    error = F.when(running & F.coalesce(F.col("now") == "interrupted", F.col("now").isNull()), F.coalesce("why", F.lit("NETWORK_FAILED"))).otherwise(F.col("error"))
    return rows.withColumns({"error": error, "state": state}).drop("now", "why")


def reaped(sessions: DataFrame, now_ms: int) -> DataFrame:
    return sessions.where(~(F.col("finished") & (F.lit(now_ms) - F.col("finished_at") > K.REAP_AFTER_MS)))


def sidecar(jobs: DataFrame) -> DataFrame:
    """The report row of each job."""
    shown = lambda c, to: F.coalesce(F.col(c), F.lit(to)) if c in jobs.columns else F.lit(to)
    return jobs.select(
        "tab_id", "index", "path", F.col("url").alias("source_url"), F.col("effective_url").alias("downloaded_url"), (F.col("url") != F.col("effective_url")).alias("upgraded"),
        "mime_type", "width", "height", "bytes", "status", F.array_join("sources", "+").alias("layer"), shown("state", "queued").alias("state"), shown("error", "").alias("error"),
    )


SIMULATED = "session string, job long, start_ms long, end_ms long, attempt int, state string"


def simulate(jobs: DataFrame, concurrency: int = K.DOWNLOAD_CONCURRENCY) -> DataFrame:
    """When each attempt runs, for jobs (session, job, host, queue, duration_ms, fails: attempts that fail with a retryable
    error). The next job is the first queued one whose host is idle; a failed attempt waits for its backoff. A session's jobs
    are one group, bounded by the index's cap on items of a tab."""
    limit = max(1, min(16, int(concurrency) or K.DOWNLOAD_CONCURRENCY))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        queue = [(0, r.queue, r.job, r.host, int(r.duration_ms), int(r.fails), 1) for r in pdf.sort_values("queue").itertuples()]
        busy: set[str] = set()
        running: list[tuple] = []
        out, now = [], 0
        while queue or running:
            ready = sorted((q for q in queue if q[0] <= now), key=lambda q: q[1])
            for q in ready:
                if len(running) < limit and q[3] not in busy:
                    queue.remove(q)
                    busy.add(q[3])
                    heapq.heappush(running, (now + q[4], q[1], q, now))
            times = [running[0][0]] if running else []
            times += [q[0] for q in queue if q[0] > now]
            if not times:
                break
            now = min(times)
            while running and running[0][0] <= now:
                end, _, q, start = heapq.heappop(running)
                busy.discard(q[3])
                failed = q[6] <= q[5]
                again = failed and q[6] < K.DOWNLOAD_TRIES
                out.append((pdf["session"].iloc[0], q[2], start, end, q[6], "backoff" if again else "failed" if failed else "done"))
                if again:
                    queue.append((end + min(K.BACKOFF_MAX_MS, K.BACKOFF_BASE_MS * 2 ** (q[6] - 1)), *q[1:6], q[6] + 1))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in SIMULATED.split(", ")])

    return jobs.groupBy("session").applyInPandas(run, SIMULATED)

"""Downloads as streams: what became of running jobs after a restart, and the progress of sessions.

``resumed`` joins the jobs that a restart found with what the browser still tells of their downloads. A job is lost only when
the watermark has passed the end of its waiting time, so a state that comes late, but in time, still counts. ``progress``
keeps per session the state of each job, counters, and the last errors; every micro-batch gives a row per session that it
touched, and the report goes out once, with the row that ends the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.downloads import outcome
from lodestone.streaming.tabs import _events, _names

LAST_ERRORS = 5
STATES = ("queued", "running", "backoff", "done", "failed", "cancelled")
PENDING = ("queued", "running", "backoff")
EVENT = "session string, seq long, job long, state string, error string"
PROGRESS = "session string, seq long, total long, done long, failed long, running long, cancelled long, pending long, percent long, finished boolean, errors array<string>, report string"


def resumed(jobs: DataFrame, states: DataFrame, wait: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """jobs (session, job, download_id, tries, state, error, found_at) with their new state and error, from states
    (download_id, state, error, told_at) that are told within ``wait`` of a job's ``found_at``; rows of both streams may come
    ``delay`` late. Jobs that were not running, and those still in progress, keep their state."""
    columns = ["session", "job", "download_id", "tries", "state", "error"]
    known = states.select(F.col("download_id").alias("id"), F.col("state").alias("now"), F.col("error").alias("why"), "told_at").withWatermark("told_at", delay)
    running = jobs.where("state = 'running' and download_id is not null").select(*columns, "found_at").withWatermark("found_at", delay)
    within = (F.col("told_at") >= F.col("found_at")) & (F.col("told_at") <= F.col("found_at") + F.expr(f"interval {wait}"))
    rows = running.join(known, (F.col("download_id") == F.col("id")) & within, "left")
    lost = F.coalesce(F.nullif("why", F.lit("")), F.when(F.col("now").isNull(), "NETWORK_FAILED").otherwise("INTERRUPTED"))
    state = F.when(F.col("now") == "complete", "done").when(F.col("now") == "in_progress", "running").otherwise(outcome(F.lit(False), lost, F.col("tries")))
    error = F.when(F.col("now").isin("complete", "in_progress"), F.lit("")).otherwise(lost)
    settled = rows.select(*columns[:4], state.alias("state"), error.alias("error"))
    return settled.unionByName(jobs.where("state <> 'running' or download_id is null").select(*columns))


class ProgressProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job long", "state string, error string")
        self.counts = handle.getValueState("counts", ", ".join(f"{s} long" for s in STATES) + ", reported boolean")
        self.errors = handle.getListState("errors", "error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.counts.get() if self.counts.exists() else (0,) * len(STATES) + (False,)
        counts, reported = dict(zip(STATES, held, strict=False)), held[-1]
        errors, last = [x for (x,) in self.errors.get()], 0
        for event in _events(pd.concat(list(rows))):
            last, job = int(event.seq), (int(event.job),)
            if event.state not in counts:
                continue
            if self.jobs.containsKey(job):
                counts[self.jobs.getValue(job)[0]] -= 1
            counts[event.state] += 1
            self.jobs.updateValue(job, (event.state, event.error or ""))
            if event.state == "failed":
                errors.append(event.error or "unknown error")
        errors = errors[-LAST_ERRORS:]
        total, pending = sum(counts.values()), sum(counts[s] for s in PENDING)
        finished, report = bool(total) and not pending, None
        if finished and not reported:
            report = json.dumps([{"job": job, "state": state, "error": error} for (job,), (state, error) in sorted(self.jobs.iterator(), key=lambda x: x[0][0])])
        self.counts.update((*counts.values(), reported or finished))
        if errors:
            self.errors.put([(x,) for x in errors])
        percent = int((counts["done"] + counts["failed"]) * 100 / total + 0.5) if total else 0
        row = (key[0], last, total, counts["done"], counts["failed"], counts["running"], counts["cancelled"], pending, percent, finished, errors, report)
        yield pd.DataFrame([row], columns=_names(PROGRESS))

    def close(self) -> None:
        pass


def progress(events: DataFrame) -> DataFrame:
    """PROGRESS rows of job events (EVENT), in update mode; events must arrive in order of seq across micro-batches of a
    session. ``report`` is null but in the row that ends a session. Needs the RocksDB state store."""
    rows = events.select(*(F.col(n).cast(t).alias(n) for n, t in (x.split(" ") for x in EVENT.split(", "))))
    return rows.groupBy("session").transformWithStateInPandas(ProgressProcessor(), PROGRESS, "Update", "None")

"""Job streams: submissions without duplicates, and sessions that expire.

The reference model has no event time; the watermark is an addition of this engine, and
its delay is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_submissions(jobs: DataFrame, time_col: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("job_type", "path")) -> DataFrame:
    """The first submission of each key within the watermark's delay; works on streams and tables."""
    if jobs.isStreaming:
        return jobs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return jobs.dropDuplicates(list(keys))


def sessions(events: DataFrame, key: str = "user_id", time_col: str = "ts", gap: str = "3600 seconds", delay: str = "1 hour") -> DataFrame:
    """(key, begun, expires, events): spans of activity that end after a silent gap."""
    e = events.withWatermark(time_col, delay) if events.isStreaming else events
    window = F.session_window(F.col(time_col), gap)
    return e.groupBy(F.col(key), window.alias("span")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("span.start").alias("begun"), F.col("span.end").alias("expires"), "events")


CLAIMS = "queue string, job_id long, event string, seq long"


def claims(events: DataFrame) -> DataFrame:
    """(queue, job_id, event, seq): what a queue with one running slot does, from a stream of (queue, job_id, action, job_type, path, ts).

    Actions: 'submit' queues a job ('replaced' are earlier queued previews of its path; a job of another type than PROCESS_MEDIA that
    equals a queued or running one is a 'duplicate'), 'finish' and 'cancel' end one. A free slot claims the first queued job. Each queue's
    state is its waiting jobs and its running one; events of one batch are taken in the order of time and job.
    """
    import json

    import pandas as pd

    def step(key, batches, state):
        waiting, running, seq = json.loads(state.get[0]) if state.exists else ([], None, 0)
        out = []

        def say(job: int, event: str) -> None:
            nonlocal seq
            seq += 1
            out.append((key[0], job, event, seq))

        rows = pd.concat(list(batches)).sort_values(["ts", "job_id"])
        for r in rows.itertuples():
            job = [int(r.job_id), r.job_type, r.path]
            if r.action == "submit":
                if job[1] == "PREVIEW":
                    for old in [w for w in waiting if w[1:] == job[1:]]:
                        waiting.remove(old)
                        say(old[0], "replaced")
                if job[1] not in ("PREVIEW", "PROCESS_MEDIA") and any(w[1:] == job[1:] for w in [*waiting, *([running] if running else [])]):
                    say(job[0], "duplicate")
                else:
                    waiting.append(job)
            elif running and running[0] == job[0]:
                say(job[0], "cancelled" if r.action == "cancel" else "completed" if running[1] == "PROCESS_MEDIA" else "failed")
                running = None
            elif r.action == "cancel" and (old := next((w for w in waiting if w[0] == job[0]), None)):
                waiting.remove(old)
                say(job[0], "cancelled")
            if running is None and waiting:
                running = waiting.pop(0)
                say(running[0], "running")
        state.update((json.dumps([waiting, running, seq]),))
        yield pd.DataFrame(out, columns=["queue", "job_id", "event", "seq"])

    return events.groupBy("queue").applyInPandasWithState(step, CLAIMS, "state string", "append", "NoTimeout")

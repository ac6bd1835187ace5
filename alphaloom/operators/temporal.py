"""Window, recurrence and job-state operators in batch form."""

from __future__ import annotations

from alphaloom.operators.points import KEYS, rnd
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import JOBS, MASKS, PIXELS

STEPS = PIXELS.join(MASKS.select(*KEYS, "uncertain", "transparent"), "clip frame_idx y x").let(d="abs(a - lag(a) over (partition by clip, y, x order by frame_idx))").where("d is not null")
REGIONAL = STEPS.agg("clip frame_idx", edge="avg(case when uncertain then d end)", effect="avg(case when transparent then d end)", every="avg(d)")


def ema(weight: float) -> tuple[str, str]:
    """s = w * s + (1 - w) * a along the ordered series; the last state."""
    return (f"aggregate(series, cast(null as double), (s, e) -> case when s is null then e.a else {weight!r}e0 * s + {1 - weight!r}e0 * e.a end)",
            f"list_reduce(list_transform(series, lambda e: e.a), lambda s, v: {weight!r}e0 * s + {1 - weight!r}e0 * v)")


LATEST = JOBS.let(k="row_number() over (partition by path, job_type order by ts desc, job_id desc)")
SEEN = table("events", "user_id", "ts").agg("user_id", last_seen="max(ts)", n="count(*)")
NOW = "timestamp '2024-01-30 12:00:00'"
AGE = ("(unix_seconds(timestamp '2024-01-30 12:00:00') - unix_seconds(cast(ts as timestamp)))", "(epoch(timestamp '2024-01-30 12:00:00')::BIGINT - floor(epoch(ts))::BIGINT)")

OPS: dict[str, Relation] = {
    "w08_flicker_by_region": REGIONAL.agg("clip", edge_flicker=rnd("coalesce(avg(edge), 0e0)"), transparent_flicker=rnd("coalesce(avg(effect), 0e0)"), max_frame_delta=rnd("max(every)")),
    "w10_queue_submit": JOBS.where("status = 'queued'").let(newer="count(*) over (partition by path, job_type order by ts, job_id rows between 1 following and unbounded following)", older="row_number() over (partition by path, job_type order by ts, job_id)").select(
        "job_id", "job_type", outcome="(case when job_type = 'PREVIEW' and newer > 0 then 'replaced' when job_type = 'PROCESS_MEDIA' then 'queued' when job_type = 'VERIFY' and older > 1 then 'duplicate' else 'queued' end)"),
    "w11_job_lifecycle": LATEST.where("k = 1").select("path", "job_type", "job_id", "status"),
    "w13_session_ttl": SEEN.let(working="(user_id % 9 = 0)").select("user_id", "n", evicted=("(unix_seconds(cast(last_seen as timestamp)) <= unix_seconds(timestamp '2024-01-30 12:00:00') - 3600 and not working)", "(floor(epoch(last_seen))::BIGINT <= epoch(timestamp '2024-01-30 12:00:00')::BIGINT - 3600 and not working)")),
    "w14_artifact_age_out": JOBS.let(age=AGE).where("age > 3600 and status <> 'queued'").select("job_id", "age"),
    "w16_queue_panel": JOBS.select("job_id", "status", "job_type", short_id="substring(sha1(cast(job_id as string)), 1, 8)", percent=("(case when total > 0 then cast(floor(least(done, total) * 100 / total) as long) else 0L end)", "(case when total > 0 then floor(least(done, total) * 100 / total)::BIGINT else 0::BIGINT end)")),
    "w18_job_snapshot_resolve": JOBS.where("status <> 'cancelled'").let(k="row_number() over (partition by path order by (case when status = 'completed' then 0 when status = 'queued' then 1 else 2 end), ts, job_id)").where("k = 1").select("path", "job_id", "status"),
    "x23_job_summary": JOBS.select("job_id", fps=rnd("(case when seconds > 0 then total / seconds else 0e0 end)")),
}

"""Joins: aligned, left, full, semi and anti, on frames and on the driver's tables."""

from __future__ import annotations

from alphaloom.operators.aggregates import SCORED
from alphaloom.operators.points import KEYS, rnd
from alphaloom.plans.relation import Relation, rows, table
from alphaloom.plans.views import BASELINE, CANDIDATES, JOBS, MASKS, METRICS, PIXELS

GENERATED = table("pages", "page_id", "url").select(path="concat('doc/', cast(page_id % 700 as string))", g_mode="(case when url like '%/en/%' then 'green' else 'auto' end)").agg("path", g_mode="min(g_mode)")
EXISTING = table("documents", "doc_id", "lang", "source").select(path="concat('doc/', cast(doc_id as string))", e_mode="(case when doc_id % 3 = 0 then cast(null as string) else lang end)", e_name="source")
REQUIRED = rows("sample string, model string", ("a", "gvm"), ("a", "rvm"), ("b", "birefnet"), ("c", "gvm"))
CONTRIBUTED = rows("sample string, model string, frames long", ("a", "gvm", 5), ("a", "rvm", 0), ("b", "gvm", 2))
FAIR = CANDIDATES.where("ord = 0").select("clip", "frame_idx", "y", "x", base="ca")

OPS: dict[str, Relation] = {
    "j01_frame_alpha_zip": PIXELS.agg("clip frame_idx", n="count(*)").join(MASKS.agg("clip frame_idx", m="count(*)"), "clip frame_idx", "outer").agg("", frames="count(*)", unmatched="count_if(n is null or m is null or n <> m)"),
    "j03_quality_by_frame_candidate": SCORED.let(k="row_number() over (partition by clip, frame_idx, candidate order by ord desc)").where("k = 1").select("clip", "frame_idx", "candidate", overall=rnd("overall")),
    "j04_baseline_left_join": METRICS.join(BASELINE, "sample", "left").select("sample", score=rnd("overall_score"), baseline=rnd("base_score"), known="(base_score is not null)"),
    "j05_manifest_merge": GENERATED.join(EXISTING, "path", "outer").select("path", mode="coalesce(e_mode, g_mode)", name="e_name", change="(case when e_name is null then 'added' when e_mode is null and g_mode is not null then 'updated' else 'kept' end)"),
    "j06_temporal_model_antijoin": REQUIRED.join(CONTRIBUTED.where("frames > 0"), "sample model", "anti"),
    "j10_adjacent_frame_pair": PIXELS.agg("clip frame_idx", m="avg(a)").let(before="lag(frame_idx) over (partition by clip order by frame_idx)", m0="lag(m) over (partition by clip order by frame_idx)").where("before is not null").select(
        "clip", "frame_idx", "before", step=rnd("m - m0")),
    "j11_candidate_by_name": FAIR.join(CANDIDATES.where("candidate = 'steep'").select(*KEYS, "ca"), "clip frame_idx y x").agg("clip frame_idx", lower="count_if(ca < base - 0.08e0)"),
    "j12_session_path_membership": JOBS.join(JOBS.where("job_type = 'PREVIEW'").select("path"), "path", "semi").select("job_id", "path"),
    "j09_active_duplicate_lookup": JOBS.where("status in ('queued', 'running')").let(k="row_number() over (partition by job_type, path order by ts, job_id)", first_job="min(job_id) over (partition by job_type, path)").where("k > 1").select("job_id", "job_type", "path", "first_job"),
    "r16_mask_union_intersect_except": MASKS.select(*KEYS, either="(hair or transparent)", both="(hair and transparent)", only_hair="(hair and not transparent)"),
    "r18_sorted_distinct_paths": table("pages", "url").select(path=("regexp_replace(url, '[?#].*$', '')", "regexp_replace(url, '[?#].*$', '')")).distinct(),
}

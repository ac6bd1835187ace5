"""Ranking, selection, sampling and set operators."""

from __future__ import annotations

from alphaloom.operators.aggregates import FRAME, SCORED
from alphaloom.operators.points import KEYS, rnd
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import CANDIDATES, COLOURS, PIXELS

#: Fixed value: order in which regions claim a pixel.
ORDER = ("subject", "hair", "luminous", "transparent", "residue", "uncertain")
LONG = None
for _k, _region in enumerate(ORDER):
    _one = SCORED.select("clip", "frame_idx", "candidate", "ord", "overall", region=f"'{_region}'", region_ord=str(_k), score=f"{_region} + 0.1e0 * overall", own=_region)
    LONG = _one if LONG is None else LONG.union(_one)

GATE = CANDIDATES.let(residue_s="0.75e0 * (1e0 - ca) + 0.25e0 * cf", subject_s="0.7e0 * cf + 0.3e0 * ca", transparent_s="0.8e0 * cf + 0.2e0 * ca")
PIXEL_BEST = GATE.let(part="(case when uncertain then 'uncertain' when subject then 'subject' when hair then 'hair' when transparent then 'transparent' when luminous then 'luminous' when residue then 'residue' else 'none' end)").let(
    s="(case when part = 'residue' then residue_s when part = 'subject' then subject_s when part = 'transparent' then transparent_s else cf end)")
NUMBERED = table("events", "event_id", "user_id", "ts", "value").let(i="row_number() over (partition by user_id order by ts, event_id) - 1", n="count(*) over (partition by user_id)")

OPS: dict[str, Relation] = {
    "r05_fusion_gate": PIXEL_BEST.let(k="row_number() over (partition by clip, frame_idx, y, x order by round(s, 9) desc, ord)").where("k = 1").select(*KEYS, "part", "candidate", alpha=rnd("ca")),
    "r06_layer_compose": PIXELS.let(subj="a", eff="ai", ev="a * ai").let(suppress="(subj <= 0.2e0 and eff <= 0.35e0)", owned="(ev >= 0.5e0 and subj <= 0.6e0 and eff < 0.85e0)").select(
        *KEYS, owner="(case when suppress or owned then 'background' when eff > 0e0 and eff > subj then 'effect' else 'subject' end)", alpha=rnd("(case when suppress or owned then 0e0 else greatest(subj, eff) end)")),
    "r08_top3_mean": PIXELS.agg(FRAME, m="avg(a)").let(k="row_number() over (partition by clip order by m desc, frame_idx)").where("k <= 3").agg("clip", top3=rnd("avg(m)")),
    "r09_top20pct_key": COLOURS.where("y = 0 or y = 7 or x = 0 or x = 7").let(k="row_number() over (partition by clip, frame_idx order by g - greatest(r, b) desc, y, x)", n="count(*) over (partition by clip, frame_idx)").where("k <= greatest(10, floor(0.2e0 * n))").agg(
        FRAME, red=rnd("avg(r)"), green=rnd("avg(g)"), blue=rnd("avg(b)")),
    "r10_p10_excess": COLOURS.let(e="g - greatest(r, b)").where("e > 0").let(k="row_number() over (partition by clip, frame_idx order by e, y, x) - 1", n="count(*) over (partition by clip, frame_idx)").where("k = floor(0.1e0 * n)").select("clip", "frame_idx", excess=rnd("e")),
    "r11_linspace_sample": NUMBERED.let(k="least(5, n)").where(("exists(sequence(0, cast(k as int) - 1), j -> i = floor(j * (n - 1) / greatest(k - 1, 1)))", "len(list_filter(range(k), lambda j: i = floor(j * (n - 1) / greatest(k - 1, 1)))) > 0")).select("event_id", "user_id"),
    "r12_head_mid_tail_sample": NUMBERED.where(("i = 0 or i = n div 2 or i = n - 1", "i = 0 or i = n // 2 or i = n - 1")).select("event_id", "user_id"),
    "n16_peak_crop": PIXELS.let(k="row_number() over (partition by clip, frame_idx order by round(abs(ai - a), 9) desc, y, x)").where("k = 1 and abs(ai - a) >= 0.05e0").select("clip", "frame_idx", "y", "x", top="greatest(0, least(y - 2, 3))", left_="greatest(0, least(x - 2, 3))", diff=rnd("ai - a")),
    "r15_merge_distinct": table("events", "event_id", "event_type", "user_id").select(code="event_type", summary="user_id", ord="event_id").union(table("events", "event_id", "event_type", "user_id").where("event_id % 3 = 0").select(code="event_type", summary="user_id", ord="event_id + 1000000000")).let(
        k="row_number() over (partition by code, summary order by ord)").where("k = 1").select("code", "summary", "ord"),
    "r17_concat_pixels": COLOURS.where("a <= 0.04e0 and y = 0").select("clip", red="r", green="g", blue="b").union(COLOURS.where("a <= 0.04e0 and y = 7").select("clip", red="r", green="g", blue="b")).agg("clip", n="count(*)", red=rnd("avg(red)")),
}

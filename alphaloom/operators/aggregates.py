"""Masked aggregations: quality signals, risks and scores by frame and clip."""

from __future__ import annotations

from alphaloom.functions import pixel as px
from alphaloom.operators.neighbours import EDGE, HOLE, SPECKLE
from alphaloom.operators.points import LAYERS, RECOVERED, hsv, rnd
from alphaloom.plans.relation import Relation, isum, table
from alphaloom.plans.views import CANDIDATES, COLOURS, MASKS, PIXELS

FRAME = "clip frame_idx"


def share(cond: str) -> str:
    return f"avg(case when {cond} then 1e0 else 0e0 end)"


def low_alpha(mask: str, limit: float) -> str:
    """Share of a mask's pixels at or under a limit, 0 for an empty mask."""
    return f"coalesce(avg(case when {mask} then (case when a <= {limit!r}e0 then 1e0 else 0e0 end) end), 0e0)"


def ratio_stats(per_frame: Relation, name: str = "v") -> Relation:
    """mean, max, 95th percentile (linear), min and mean of the three largest, by clip."""
    top = per_frame.let(k=f"row_number() over (partition by clip order by {name} desc, frame_idx)").where("k <= 3").agg("clip", top3=f"avg({name})")
    return per_frame.agg("clip", mean_v=f"avg({name})", max_v=f"max({name})", p95=f"percentile({name}, 0.95)", min_v=f"min({name})").join(top, "clip")


def level(score: str) -> str:
    return f"(case when {score} >= 0.7e0 then 'fail' when {score} >= 0.35e0 then 'warn' else 'pass' end)"


FLICKER = PIXELS.let(d="abs(a - lag(a) over (partition by clip, y, x order by frame_idx))").where("d is not null").agg(FRAME, m="avg(d)").agg("clip", flicker="avg(m)")
PER_FRAME = EDGE.agg(FRAME, edge=share("edge"), n="count(*)").join(PIXELS.agg(FRAME, residue="sum(case when a < 0.05e0 then a else 0e0 end) / count(*)"), FRAME)
COUNTS = PER_FRAME.agg("clip", frames="count(*)", edge="avg(edge)", residue="avg(residue)", cells="sum(n)").join(
    SPECKLE.agg("clip", speckles="count(*)"), "clip", "left").join(HOLE.agg("clip", holes="count(*)"), "clip", "left").join(FLICKER, "clip", "left").select(
        "clip", "frames", "edge", "residue", "cells", speckles="coalesce(speckles, 0)", holes="coalesce(holes, 0)", flicker="coalesce(flicker, 0e0)")
QUALITY = COUNTS.let(score="1e0 - least(1e0, 0.35e0 * edge + 0.2e0 * residue + 0.35e0 * flicker + 0.5e0 * least(1e0, (speckles + holes) / cast(cells as double)))")

HAIR = ratio_stats(MASKS.agg(FRAME, v=low_alpha("hair", 0.08)))
LIGHT = ratio_stats(MASKS.agg(FRAME, v=low_alpha(f"({px.LIGHT_LOW_SATURATION} and subject)", 0.35)))
TRANSPARENT = ratio_stats(MASKS.agg(FRAME, v=low_alpha("(transparent or luminous)", 0.08)))
RESIDUE = ratio_stats(MASKS.agg(FRAME, v=share("residue")))
COVER = ratio_stats(MASKS.agg(FRAME, v=share("subject"))).join(MASKS.agg(FRAME, solid=share("a >= 0.7e0")).agg("clip", solid="avg(solid)"), "clip")
R_HAIR = HAIR.join(QUALITY, "clip").select("clip", score="least(1e0, greatest(edge / 0.12e0, holes / cast(cells as double) / 0.01e0, max_v / 0.9e0, top3 / 0.5e0))")
R_RESIDUE = RESIDUE.join(QUALITY, "clip").select("clip", score="least(1e0, greatest(residue / 0.1e0, max_v / 0.2e0, top3 / 0.1e0))")
R_LIGHT = LIGHT.select("clip", score="least(1e0, greatest(max_v / 0.9e0, top3 / 0.5e0))")
R_EFFECT = TRANSPARENT.select("clip", score="least(1e0, greatest(max_v / 0.9e0, top3 / 0.5e0))")
R_TEMPORAL = QUALITY.select("clip", score="least(1e0, flicker / 0.2e0)")
R_SUBJECT = COVER.select("clip", score="(case when mean_v = 0 and solid = 0 then 0e0 when min_v < 0.03e0 then 0.6e0 else 0e0 end)")
RISKS = {"hair_edge_loss": R_HAIR, "background_residue": R_RESIDUE, "light_subject_loss": R_LIGHT, "transparent_effect_loss": R_EFFECT, "temporal_instability": R_TEMPORAL, "subject_misidentification": R_SUBJECT}


def risk(rel: Relation) -> Relation:
    return rel.select("clip", score=rnd("score"), level=level("score"))


def all_risks() -> Relation:
    out = None
    for k, (name, rel) in enumerate(RISKS.items()):
        one = rel.select("clip", ord=str(k), risk=f"'{name}'", score=rnd("score"), level=level("score"))
        out = one if out is None else out.union(one)
    return out


#: Border strips: a quarter of the frame at each side; corners belong to two strips and count twice.
STRIPS = COLOURS.where("y < 2").union(COLOURS.where("y >= 6")).union(COLOURS.where("x < 2")).union(COLOURS.where("x >= 6"))
GREEN = hsv().agg(FRAME, ratio=share("hue >= 35 and hue <= 85 and sat >= 80 and val >= 30")).join(STRIPS.agg(FRAME, sd="(stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3e0"), FRAME).select(
    "clip", "frame_idx", green="least(1e0, 0.7e0 * ratio + 0.3e0 * (1e0 - least(sd / 50e0, 1e0)))")
BLACK = COLOURS.agg(FRAME, dark=share("br < 20"), bright=share("br > 100")).join(STRIPS.agg(FRAME, m="avg(br)"), FRAME).select(
    "clip", "frame_idx", black="least(1e0, 0.5e0 * dark + least(2e0 * bright, 0.3e0) + 0.2e0 * greatest(0e0, (30e0 - m) / 30e0))")
#: At most five evenly spaced frames of a clip, both ends included.
SAMPLED = GREEN.join(BLACK, FRAME).let(i="row_number() over (partition by clip order by frame_idx) - 1", n="count(*) over (partition by clip)").let(k="least(5, n)").where(
    ("exists(sequence(0, cast(k as int) - 1), j -> i = floor(j * (n - 1) / greatest(k - 1, 1)))", "len(list_filter(range(k), lambda j: i = floor(j * (n - 1) / greatest(k - 1, 1)))) > 0"))
CLASSIFIED = SAMPLED.agg("clip", g="avg(green)", b="avg(black)").select(
    "clip", green=rnd("g"), black=rnd("b"), background="(case when g > 0.6e0 and g > b then 'green' when b > 0.6e0 and b > g then 'black' when greatest(g, b) > 0.4e0 then (case when g > b then 'green' else 'black' end) else 'unknown' end)")

REGIONS = ("subject", "hair", "luminous", "transparent", "residue", "uncertain")
#: Weights of the six regions in a candidate's overall score.
WEIGHTS = {"subject": 1.4, "hair": 1.1, "luminous": 1.2, "transparent": 1.2, "residue": 1.3, "uncertain": 0.8}


def mean_alpha(mask: str, high: bool = True) -> str:
    v = f"avg(case when {mask} then ca end)"
    return f"coalesce({v if high else f'1e0 - {v}'}, 0.5e0)"


def soft_alpha(mask: str) -> str:
    return f"coalesce(0.8e0 * avg(case when {mask} then 1e0 - 2e0 * abs(ca - 0.5e0) end) + 0.2e0 * (1e0 - avg(case when {mask} then (case when ca <= 0.05e0 then 1e0 else 0e0 end) end)), 0.5e0)"


SCORES = CANDIDATES.agg("clip frame_idx candidate ord", subject=mean_alpha("subject"), hair=soft_alpha("hair"), luminous=soft_alpha("luminous"), transparent=soft_alpha("transparent"),
                        residue=mean_alpha("residue", high=False), uncertain=soft_alpha("uncertain"), mean_a="avg(ca)", soft="avg(case when ca > 0.05e0 and ca < 0.95e0 then 1e0 else 0e0 end)")
SCORED = SCORES.let(overall="least(1e0, greatest(0e0, (" + " + ".join(f"{w!r}e0 * {k}" for k, w in WEIGHTS.items()) + ") / 7e0))")
FRAME_COUNTS = MASKS.agg("clip", frames=("count(distinct frame_idx)"), cells="count(*)", **{k: f"count_if({k})" for k in REGIONS})
PART = LAYERS.let(gate=px.smoothstep("sc", 0.45, 0.80), fb="greatest(ai, a * 0.98e0)")
DELTAS = PART.agg(FRAME, entity="coalesce(avg(case when gate >= 0.55e0 then fb - ai end), 0e0)", effect="coalesce(avg(case when ew >= 0.35e0 and gate <= 0.35e0 then fb - ai end), 0e0)",
                  transition="coalesce(avg(case when not (gate >= 0.55e0) and not (ew >= 0.35e0 and gate <= 0.35e0) and a > 0.02e0 then fb - ai end), 0e0)").agg(
                      "clip", entity="avg(entity)", effect="avg(effect)", transition="avg(transition)").let(weighted="0.65e0 * entity + 0.15e0 * effect + 0.2e0 * transition")
EXCESS = PIXELS.select("clip", "frame_idx", r="r / 255e0", g="g / 255e0", b="b / 255e0").let(gx="greatest(0e0, g - greatest(r, b))", bx="greatest(0e0, b - greatest(r, g))", br="(r + g + b) / 3e0", ch="greatest(r, g, b) - least(r, g, b)").let(screen="(gx > 0.12e0 or bx > 0.12e0)")
AUTO = EXCESS.agg(FRAME, green_excess="avg(gx)", blue_excess="avg(bx)", white_subject=share("not screen and br > 0.66e0 and ch < 0.22e0"), pink_glow=share("not screen and r > g + 0.12e0 and b > g + 0.04e0 and br > 0.45e0"),
                  white_glow=share("not screen and br > 0.72e0 and ch < 0.35e0"), green_haze=share("gx > 0.04e0 and gx < 0.2e0 and br > 0.22e0"))

#: Ranks of candidates by region: regions as columns of a score, unpivoted.
RANKED = None
for _region in REGIONS:
    _one = SCORED.select("clip", "frame_idx", "candidate", "ord", "overall", region=f"'{_region}'", rank=f"{_region} + 0.1e0 * overall", own=_region)
    RANKED = _one if RANKED is None else RANKED.union(_one)
_HAIR_SIGNALS = HAIR.join(QUALITY, "clip").let(ratio="holes / cast(cells as double)")
SIGNALS = None
for _name, _column in (("quality_mean_edge_uncertainty", "edge"), ("quality_hole_ratio", "ratio"), ("hair_low_alpha_ratio", "mean_v"), ("hair_low_alpha_ratio_max", "max_v"), ("hair_low_alpha_ratio_p95", "p95"), ("hair_low_alpha_ratio_top3_mean", "top3")):
    _one = _HAIR_SIGNALS.select("clip", signal=f"'{_name}'", value=f"round({_column}, 6)")
    SIGNALS = _one if SIGNALS is None else SIGNALS.union(_one)

#: Forms whose SQL the queries of framed.py are held against.
FORMS: dict[str, Relation] = {
    "a01": QUALITY.select("clip", "frames", "speckles", "holes", edge=rnd("edge"), residue=rnd("residue"), flicker=rnd("flicker"), overall_score=rnd("greatest(0e0, least(1e0, score))")),
    "a11": risk(R_HAIR), "a12": risk(R_RESIDUE), "a13": risk(R_LIGHT), "a14": risk(R_EFFECT), "a15": risk(R_TEMPORAL), "a16": risk(R_SUBJECT),
    "a17": QUALITY.select("clip", level=level("(1e0 - score) * 4e0")), "a18": all_risks(), "x35": SIGNALS, "w01": FLICKER.select("clip", flicker=rnd("flicker")), "ranked": RANKED,
}

OPS: dict[str, Relation] = {
    "a02_background_residue": PIXELS.agg(FRAME, v="sum(case when a < 0.05e0 then a else 0e0 end) / count(*)").agg("clip", residue=rnd("avg(v)")),
    "a03_bg_score_green": GREEN.select("clip", "frame_idx", green=rnd("green")),
    "a04_bg_score_black": BLACK.select("clip", "frame_idx", black=rnd("black")),
    "a05_bg_classify": CLASSIFIED,
    "a06_region_pixel_counts": FRAME_COUNTS,
    "a08_ratio_stats": ratio_stats(PIXELS.agg(FRAME, v="avg(a)")).select("clip", mean=rnd("mean_v"), max=rnd("max_v"), p95=rnd("p95"), min=rnd("min_v"), top3=rnd("top3")),
    "a09_masked_ratio": RESIDUE.select("clip", mean=rnd("mean_v"), max=rnd("max_v"), p95=rnd("p95"), min=rnd("min_v"), top3=rnd("top3")),
    "a10_low_alpha_ratio": MASKS.agg(FRAME, hair=rnd(low_alpha("hair", 0.08)), effect=rnd(low_alpha("(transparent or luminous)", 0.08)), light=rnd(low_alpha(f"({px.LIGHT_LOW_SATURATION} and subject)", 0.35))),
    "a19_candidate_quality": SCORED.select("clip", "frame_idx", "candidate", overall=rnd("overall"), mean_alpha=rnd("mean_a"), soft_ratio=rnd("soft"), **{f"{k}_score": rnd(k) for k in WEIGHTS}),
    "a20_mean_alpha_score": SCORES.select("clip", "frame_idx", "candidate", subject=rnd("subject"), residue=rnd("residue")),
    "a21_soft_alpha_score": SCORES.select("clip", "frame_idx", "candidate", hair=rnd("hair"), uncertain=rnd("uncertain")),
    "a22_candidate_summary": SCORED.agg("candidate", overall=rnd("avg(overall)"), frames="count(*)"),
    "a26_recovery_diag": RECOVERED.agg(FRAME, attempted="count_if(repair)", accepted="count_if(weight > 0 and gain > 2)", w="coalesce(avg(case when weight > 0 and gain > 2 then weight end), 0e0)").agg(
        "clip", attempted=isum("attempted"), accepted=isum("accepted"), rejected=isum("attempted - accepted"), mean_weight=rnd("sum(w * accepted) / greatest(sum(accepted), 1)")),
    "a28_stage_delta": PIXELS.agg(FRAME, mean_delta=rnd("avg(abs(ai - a))"), changed="count_if(abs(ai - a) > 1e-4)", lifted="count_if(ai - a > 0.03e0)", suppressed="count_if(a - ai > 0.03e0)"),
    "a29_alpha_mae_mse": PIXELS.agg("clip", mae=rnd("avg(abs(ai - a))"), mse=rnd("avg((ai - a) * (ai - a))")),
    "a30_unknown_candidate_score": PIXELS.agg(FRAME, solid=share("a > 0.95e0"), mean_a="avg(a)", soft=share("a > 0.05e0 and a < 0.95e0"), cover=share("a > 0.01e0")).agg(
        "clip", score=rnd("avg(1.2e0 * solid + 0.35e0 * least(mean_a, 0.65e0) - 0.3e0 * soft - (case when cover > 0.98e0 and solid < 0.1e0 then 0.45e0 else 0e0 end))")),
    "a31_fallback_region_quality": DELTAS.select("clip", entity=rnd("entity"), effect=rnd("effect"), transition=rnd("transition"), weighted=rnd("weighted")),
    "a32_materially_better": DELTAS.select("clip", verdict="(case when effect < -0.03e0 then 'effect_damage' when weighted < 0.02e0 then 'score' else 'better' end)"),
    "a34_auto_param_metrics": AUTO.select("clip", "frame_idx", **{k: rnd(k) for k in ("green_excess", "blue_excess", "white_subject", "pink_glow", "white_glow", "green_haze")}, screen_purity=rnd("greatest(green_excess, blue_excess)")),
    "u18_auto_params": AUTO.select("clip", "frame_idx", screen="(case when blue_excess > green_excess * 1.15e0 then 'blue' else 'green' end)", similarity="(case when greatest(green_excess, blue_excess) > 0.22e0 then 0.35e0 when greatest(green_excess, blue_excess) < 0.1e0 then 0.55e0 else 0.4e0 end)",
                                   key_strength="(case when white_subject > 0.08e0 then 0.95e0 else 1e0 end)", preserve="(case when pink_glow > 0.05e0 or white_glow > 0.08e0 then 0.72e0 else 0.7e0 end)",
                                   despill="(case when green_haze > 0.18e0 then 0.78e0 else 0.7e0 end)", edge_factor="(case when green_haze > 0.18e0 then 1.3e0 else 1.2e0 end)"),
    "a39_takeover_counts": CANDIDATES.where("ord = 0").select("clip", "frame_idx", "y", "x", base="ca", base_conf="cf").join(CANDIDATES.where("ord > 0").select("clip", "frame_idx", "y", "x", "candidate", "ca", "cf"), "clip frame_idx y x").agg(
        "clip candidate", lower="count_if(ca < base - 0.08e0 and cf > base_conf - 0.5e0)", higher="count_if(ca > base + 0.08e0 and cf > base_conf - 0.5e0)"),
    "a37_summary_by_input": table("conversations", "conv_id", "turn", "role", "text").let(first_turn="min(turn) over (partition by conv_id, role)", n="count(*) over (partition by conv_id, role)").let(
        k="row_number() over (partition by conv_id order by n desc, first_turn, turn, role)").agg("conv_id", turns="count(*)", dominant="max(case when k = 1 then role end)", mean_chars=rnd("avg(length(text))"), long_turns="count_if(length(text) > 200)"),
}

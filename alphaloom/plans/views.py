"""Tables that queries run over: by default views of the test data, or what a caller binds in their place (alphaloom.api).

The test data has no images, so each 64-value vector becomes an 8 x 8 frame: clip = label,
frame_idx = vec_id, position p = 8 y + x. These views are analogs chosen for testing. Bound
frames may have any size; PIXELS and FRAMES are made of each other, whichever is bound.
"""

from __future__ import annotations

from alphaloom.functions import pixel as px
from alphaloom.frames.api import cells, pack
from alphaloom.plans.relation import Relation, slot, table


def _value(shift: int) -> tuple[str, str]:
    at = f"(p + {shift}) % 64" if shift else "p"
    return f"cast(element_at(embedding, cast({at} + 1 as int)) as double)", f"embedding[({at} + 1)::INT]::DOUBLE"


def _on(expr: str, shift: int) -> tuple[str, str]:
    s, d = _value(shift)
    return expr.replace("V", s), expr.replace("V", d)


#: (clip, frame_idx, y, x, r, g, b, a, ai): colours are whole numbers on 0..255, alphas on 0..1.
PIXELS: Relation = slot("pixels", (
    table("embeddings", "vec_id", "embedding", "label")
    .explode("p", ("sequence(0, 63)", "range(64)"))
    .select(
        clip="label", frame_idx="vec_id", y=("cast(p div 8 as int)", "(p // 8)::INT"), x=("cast(p % 8 as int)", "(p % 8)::INT"),
        r=_on("cast(floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V))) as double)", 0), g=_on("cast(floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V))) as double)", 21),
        b=_on("cast(floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V))) as double)", 42), a=_on("greatest(0e0, least(1e0, 0.5e0 + 4e0 * V))", 0), ai=_on("greatest(0e0, least(1e0, 0.5e0 + 4e0 * V))", 7))),
    lambda bound: cells(bound["frames"], "r", "g", "b", "a", "ai") if "frames" in bound else None)


def _array(expr: str, shift: int) -> str:
    return f"transform(sequence(0, 63), p -> {_on(expr, shift)[0]})"


_COLOUR, _ALPHA = "cast(floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V))) as double)", "greatest(0e0, least(1e0, 0.5e0 + 4e0 * V))"

#: The same as one row a frame: (clip, frame_idx, height, width, r, g, b, a, ai), values row by row. It has no SQL of its own.
FRAMES: Relation = slot("frames", table("embeddings", "vec_id", "embedding", "label").select(
    clip="label", frame_idx="vec_id", height="8", width="8", r=(_array(_COLOUR, 0), ""), g=(_array(_COLOUR, 21), ""), b=(_array(_COLOUR, 42), ""), a=(_array(_ALPHA, 0), ""), ai=(_array(_ALPHA, 7), "")),
    lambda bound: pack(bound["pixels"], "r", "g", "b", "a", "ai") if "pixels" in bound else None)

#: PIXELS with brightness, chroma and channel extremes.
COLOURS: Relation = PIXELS.let(br="(r + g + b) / 3e0", mx="greatest(r, g, b)", mn="least(r, g, b)").let(ch="mx - mn")

#: COLOURS with six ownership masks, which may overlap (the pointwise parts of each rule).
MASKS: Relation = (
    COLOURS.let(luminous=f"({px.WARM_SHELL} or {px.BRIGHT_CORE})")
    .let(transparent=f"(a > 0.08e0 and a < 0.82e0 and br > 135 and ch < 120 and {px.NON_SCREEN} and not luminous)", uncertain=px.UNCERTAIN)
    .let(hair="(uncertain and br > 80 and ch < 180 and not luminous)",
         residue=f"(a > 0.35e0 and br > 175 and ch < 45 and not luminous and not transparent and not (a >= 0.88e0 and br > 175 and ch < 70 and {px.NON_SCREEN}))")
    .let(subject="(a >= 0.7e0 and not residue)"))

#: Three candidates for each pixel: the base alpha, a flattened one and a steeper one; confidence null means 1.
CANDIDATES: Relation = (
    MASKS.select("clip", "frame_idx", "y", "x", "a", "ai", "subject", "hair", "luminous", "transparent", "residue", "uncertain")
    .explode("ord", ("sequence(0, 2)", "range(3)"))
    .let(candidate="(case when ord = 0 then 'base' when ord = 1 then 'flat' else 'steep' end)", ca="(case when ord = 0 then a when ord = 1 then 0.25e0 + 0.5e0 * ai else a * a end)",
         conf="(case when ord = 0 then cast(null as double) when ord = 1 then 0.3e0 + 0.6e0 * ai else 0.9e0 - 0.5e0 * a end)")
    .let(cf="coalesce(conf, 1e0)"))

#: One row of quality metrics for each supplier ("sample"), from its lines.
METRICS: Relation = slot("metrics", (
    table("lineitem", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    .agg("l_suppkey", overall_score="1e0 - 3.8e0 * avg(l_discount)", edge="2e0 * avg(l_tax)", holes="count_if(l_quantity >= 41)", residue="0.06e0 * avg(case when l_returnflag = 'R' then 1e0 else 0e0 end)",
         flicker="0.2e0 * stddev_pop(l_discount) * 15e0 / 2e0", edge_flicker="1.9e0 * avg(l_tax)", transparent_flicker="0.16e0 * avg(case when l_linestatus = 'O' then 1e0 else 0e0 end)",
         frame_delta="0.12e0 * max(l_discount) * 10e0", hair_low="0.6e0 * avg(case when l_quantity < 25 then 1e0 else 0e0 end)", effect_low="0.6e0 * avg(case when l_quantity > 25 then 1e0 else 0e0 end)",
         hair_risk="avg(case when l_quantity < 20 then 1e0 else 0e0 end) * 1.8e0")
    .select("overall_score", "edge", "holes", "residue", "flicker", "edge_flicker", "transparent_flicker", "frame_delta", "hair_low", "effect_low", "hair_risk", sample="concat('supplier_', cast(l_suppkey as string))", k="l_suppkey")))

#: Baselines for three in four samples.
BASELINE: Relation = slot("baseline", table("supplier", "s_suppkey", "s_acctbal").where("s_suppkey % 4 <> 0").select(
    sample="concat('supplier_', cast(s_suppkey as string))", base_score="0.75e0 + 0.2e0 * (s_acctbal / 10000e0)", base_hair="0.3e0 + 0.4e0 * (s_acctbal / 10000e0)"))

#: Jobs: one submission for each event. Status and progress follow from the event's value.
JOBS: Relation = slot("jobs", table("events", "event_id", "ts", "user_id", "event_type", "value").let(v="coalesce(value, 0e0)").select(
    "ts", job_id="event_id", path="user_id", job_type="(case when event_type in ('view', 'click') then 'PREVIEW' when event_type = 'purchase' then 'PROCESS_MEDIA' else 'VERIFY' end)",
    status="(case when event_id % 7 = 0 then 'failed' when event_id % 11 = 0 then 'cancelled' when event_id % 5 = 0 then 'queued' else 'completed' end)",
    done=("cast(event_id % 90 as long)", "(event_id % 90)::BIGINT"), total=("cast(event_id % 97 as long)", "(event_id % 97)::BIGINT"), seconds="v"))

"""Projections: pointwise keying, layer and colour expressions over the pixel table."""

from __future__ import annotations

from alphaloom.functions import pixel as px
from alphaloom.functions.pixel import clip, one, pick, smoothstep
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import CANDIDATES, COLOURS, MASKS, PIXELS

KEYS = ("clip", "frame_idx", "y", "x")


def rnd(x: str) -> str:
    """Six digits, half-way values upwards in both engines, and no negative zero."""
    return f"(round({x} + 1e-9, 6) + 0e0)"


def shown(rel: Relation, *also: str, **cols) -> Relation:
    """Pixel keys with rounded expressions."""
    return rel.select(*KEYS, *also, **{k: rnd(e) if isinstance(e, str) else (rnd(e[0]), rnd(e[1])) for k, e in cols.items()})


EFFECT = COLOURS.let(ew=px.effect_weight())

#: Despill settings (strength, edge factor, protected white brightness and saturation).
STRENGTH, EDGE, WHITE_BR, WHITE_SAT = 0.7, 1.2, 180, 25
WHITE = f"(br > {WHITE_BR} and abs(r - g) + abs(g - b) + abs(r - b) < {WHITE_SAT})"


def screen_key(similarity: float = 0.4, strength: float = 1.0) -> Relation:
    """Chroma key on the green or blue excess of each frame's screen colour."""
    scale = min(1.35, max(0.52, 1 + (0.4 - min(1.0, max(0.1, similarity))) * 0.8))
    unit = PIXELS.select(*KEYS, "a", r="r / 255e0", g="g / 255e0", b="b / 255e0").let(
        green_x="greatest(0e0, g - greatest(r, b))", blue_x="greatest(0e0, b - greatest(r, g))")
    frame = unit.agg("clip frame_idx", green_m="avg(green_x)", blue_m="avg(blue_x)", n="count(*)").select("clip", "frame_idx", "n", blue="blue_m > green_m")
    keyed = unit.join(frame, "clip frame_idx").let(key0=f"least(1e0, (case when blue then blue_x / {0.30 * scale!r}e0 else green_x / {0.35 * scale!r}e0 end))")
    if strength != 1.0:
        keyed = keyed.let(key1=f"pow(key0, {1 / max(strength, 0.1)!r}e0)")
    else:
        keyed = keyed.let(key1="key0")
    warm = "(r > 0.48e0 and g > 0.42e0 and b < 0.58e0 and r - b > 0.16e0 and g - b > 0.1e0 and r + 0.26e0 > g)"
    core = f"({warm} and r > 0.62e0 and g > 0.5e0 and b < 0.5e0)"
    return keyed.let(warm=warm, key2=f"(case when blue then key1 when {core} then 0e0 when {warm} then key1 * 0.18e0 else key1 end)").let(
        key=f"key2 * {clip('(greatest(r, g, b) - 0.03e0) / 0.07e0')}").let(alpha0="1e0 - key").let(
        alpha="(case when n < 4096 then alpha0 when key >= 0.65e0 then 0e0 when key >= 0.5e0 then alpha0 * (1e0 - least(1e0, (key - 0.5e0) / 0.15e0)) else alpha0 end)")


KEYED = screen_key()


def hsv() -> Relation:
    """8-bit hue (0..179), saturation and value."""
    v, d = "mx", "(mx - mn)"
    hue = f"(case when {d} = 0 then 0e0 when mx = r then 60e0 * (g - b) / {d} when mx = g then 120e0 + 60e0 * (b - r) / {d} else 240e0 + 60e0 * (r - g) / {d} end)"
    return COLOURS.let(h0=hue).let(h=("cast(floor((case when h0 < 0 then h0 + 360e0 else h0 end) / 2e0 + 0.5e0) as long)", "floor((case when h0 < 0 then h0 + 360e0 else h0 end) / 2e0 + 0.5e0)::BIGINT")).let(
        hue="(case when h >= 180 then h - 180 else h end)", sat=(f"cast(floor(case when mx > 0 then 255e0 * {d} / mx else 0e0 end + 0.5e0) as long)", f"floor(case when mx > 0 then 255e0 * {d} / mx else 0e0 end + 0.5e0)::BIGINT"),
        val=(f"cast({v} as long)", f"{v}::BIGINT"))


def despilled() -> Relation:
    """Green despill with white protection, haze and pink haze handling; compensates red and blue by half."""
    haze = "((case when g > r + 4 and g >= b - 3 and glow then 1 else 0 end) = 1)"
    pink = "((case when glow and br > 135 and r > b + 10 and g > b + 6 and g > 145 then 1 else 0 end) = 1)"
    d = COLOURS.let(glow="(a > 0.005e0 and a < 0.85e0)", edge="(a > 0.05e0 and a < 0.95e0)", tint="(g > r + 15 and g > b + 15)", white=WHITE)
    f = f"{STRENGTH!r}e0 * {EDGE!r}e0"
    d = d.let(haze=haze, pink=pink, d0=f"greatest(0e0, g - greatest(r, b)) * {f} * {clip('(0.95e0 - a) / 0.9e0')}",
              d1=f"greatest(greatest(0e0, g - r - 2) * {f} * {clip('(0.7e0 - a) / 0.7e0')}, greatest(0e0, g - greatest(r, b) - 3) * {f})",
              d2=f"greatest(0e0, g - b - 2) * {f} * {clip('(0.7e0 - a) / 0.7e0')} * 1.55e0")
    d = d.let(d3="(case when haze then greatest(d0, d1) else d0 end)").let(d4="(case when pink then greatest(d3, d2) else d3 end)")
    d = d.let(d5="(case when (tint and edge) or haze or pink then d4 else 0e0 end) * (case when white then 0.05e0 else 1e0 end)")
    return d.let(rc="r + d5 * 0.5e0", gc="g - d5", bc="b + d5 * 0.5e0")


DESPILLED = despilled()
CORRECTED = DESPILLED.let(cbr="(rc + gc + bc) / 3e0", cch="greatest(rc, gc, bc) - least(rc, gc, bc)")
SCREEN = ("0e0", "255e0", "0e0")


def unmixed(floor: float) -> dict[str, str]:
    """Foreground colours with the screen's share taken out, for a screen of pure green."""
    return {f"{c}f": clip(f"({c} - (1e0 - a) * {s}) / greatest(a, {floor!r}e0)", 0.0, 255.0) for c, s in zip("rgb", SCREEN)}


RECOVERED = COLOURS.let(**unmixed(0.16)).let(repair="(a > 0.02e0 and a < 0.98e0)", bias="greatest(0e0, g - greatest(r, b))")
RECOVERED = RECOVERED.let(weight=f"(case when repair then greatest({clip('(bias - 4) / 32e0')}, 0.35e0) * {clip('(0.98e0 - a) / 0.5e0')} else 0e0 end)",
                          gain="(g - greatest(r, b)) - (gf - greatest(rf, bf))", shift="(abs(rf - r) + abs(gf - g) + abs(bf - b)) / 3e0")

LAYERS = EFFECT.let(sc=px.subject_confidence(), core="a", detail="ai", fx="a * ai")
FLOOR10 = COLOURS.agg("clip frame_idx", p10="percentile(a, 0.1)").select("clip", "frame_idx", floor="least(p10 + 0.02e0, 0.95e0)")
SOLID = f"((a >= 0.94e0 and {px.NON_SCREEN}) or (a >= 0.92e0 and {px.SOLID_FOREGROUND}) or (a >= 0.28e0 and {px.SOFT_SUBJECT}))"
AI_SOLID = f"(ai >= 0.98e0 and (a >= 0.75e0 or ({px.SOFT_SUBJECT} and (ew <= 0.45e0 or a >= 0.32e0)) or ({px.SOLID_FOREGROUND} and ew <= 0.45e0 and a >= 0.55e0)))"
GATE = smoothstep("sc", 0.45, 0.80)
EFFECT_LAYER = EFFECT.join(FLOOR10, "clip frame_idx").let(t=clip("(a - floor) / greatest(1e0 - floor, 1e-6)")).let(
    effect=clip(f"greatest({smoothstep('t', 0.08, 0.75)} * {px.haze_suppression()} * ew, {px.white_ring_boost()})"))
SMOKE_A = f"greatest({clip('(br - 4) / 48e0')} * 0.3e0, 0.08e0) * {one(px.SMOKE)}"
GLOW_A = f"greatest(0.3e0, 0.78e0 * greatest({smoothstep('(br / 255e0)', 0.08, 0.55)}, {smoothstep(px.SATURATION, 0.08, 0.45)})) * {one(px.GLOW)}"
CONFIDENT = "(0.6e0 * core * c1 * c1 + 0.25e0 * detail * c2 * c2 + 0.15e0 * fx * c3 * c3) / greatest(0.6e0 * c1 * c1 + 0.25e0 * c2 * c2 + 0.15e0 * c3 * c3, 1e-6)"

_rescue_blocked = ("(br >= 184 and ch <= 18 and a <= 0.24e0) or (br >= 190 and b - g >= 30 and b - r >= 50 and a <= 0.3e0)"
                   " or (br >= 192 and ch <= 48 and b - g >= 35 and b - r >= 40 and ew >= 0.1e0 and a <= 0.3e0)")

OPS: dict[str, Relation] = {
    "p01_clip01": shown(PIXELS.let(raw="3e0 * a - 1e0"), v=clip("raw")),
    "p02_smoothstep": shown(PIXELS, ramp=smoothstep("a", 0.08, 0.75), step=smoothstep("a", 0.5, 0.5)),
    "p03_brightness_chroma": shown(COLOURS, brightness="br", chroma="ch", saturation=px.SATURATION),
    "p04_rgb_to_hsv": hsv().select(*KEYS, "hue", "sat", "val"),
    "p05_to_gray": shown(PIXELS, gray="floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0) / 255e0"),
    "p07_screen_color_auto": PIXELS.agg("clip frame_idx", gx="avg(greatest(0e0, g - greatest(r, b)))", bx="avg(greatest(0e0, b - greatest(r, g)))").select(
        "clip", "frame_idx", screen="(case when bx > gx then 'blue' else 'green' end)"),
    "p08_warm_key_protect": shown(KEYED, protected="key2", plain="key1"),
    "p09_screen_core_suppress": shown(KEYED.let(big="(case when key >= 0.65e0 then 0e0 when key >= 0.5e0 then alpha0 * (1e0 - least(1e0, (key - 0.5e0) / 0.15e0)) else alpha0 end)"), alpha="alpha", large_frame="big"),
    "p12_soft_over": shown(PIXELS, alpha=px.over("a", "ai")),
    "p13_weighted_fuse": shown(LAYERS, all_layers="(0.6e0 * core + 0.25e0 * detail + 0.15e0 * fx) / 1e0", without_fx="(0.6e0 * core + 0.25e0 * detail) / 0.85e0"),
    "p14_confidence_fuse": shown(LAYERS.let(c1="a", c2="ai", c3="0.5e0"), alpha=CONFIDENT),
    "p15_unmix_foreground": shown(RECOVERED, red="rf", green="gf", blue="bf"),
    "p16_recovery_weight": shown(RECOVERED, weight="weight"),
    "p17_recovery_gate": RECOVERED.select(*KEYS, accepted="repair and gain > 2 and not (a < 0.16e0 or (shift > 128 and gain < 24))"),
    "p18_green_despill": shown(DESPILLED, red="rc", green="gc", blue="bc"),
    "p20_screen_unmix_blend": shown(
        DESPILLED.let(**unmixed(0.18)).let(mix=clip("(greatest(0e0, g - r) + 0.5e0 * greatest(0e0, g - b) - 12) / 64e0")).let(
            w=f"(case when a > 0.18e0 and a < 0.88e0 and mix > 0 then mix * {clip('(0.95e0 - a) / 0.2e0', 0.7, 1.0)} else 0e0 end)"),
        red="rc * (1e0 - w) + rf * w", green="gc * (1e0 - w) + gf * w", blue="bc * (1e0 - w) + bf * w"),
    "p21_dark_glow_lift": shown(
        CORRECTED.let(lift=f"(case when a > 0.02e0 and a < 0.78e0 and cbr < 105 and not white then {clip('(122 - cbr) * 0.9e0', 0.0, 72.0)} else 0e0 end)"),
        red="rc + lift * 1.2e0", green="gc + lift * 0.12e0", blue="bc + lift * 1.05e0"),
    "p22_teal_cleanup": shown(
        CORRECTED.let(gap="(case when a > 0.02e0 and a < 0.78e0 and cbr > 135 and cch < 90 and gc > rc + 10 and bc > rc + 10 then greatest(0e0, least(gc - rc, bc - rc)) else 0e0 end)"),
        red="rc + gap * 0.5e0", green="gc - gap * 0.18e0"),
    "p24_high_alpha_teal": shown(
        CORRECTED.let(gap="(case when a > 0.45e0 and cbr > 70 and cbr < 190 and rc < 130 and bc < 185 and gc > rc + 12 and gc > bc + 3 then greatest(0e0, gc - rc) else 0e0 end)"),
        red="rc + gap * 1.15e0", green="gc - gap * 0.3e0"),
    "p28_transparency_band": PIXELS.select(*KEYS, band="(a > 0.02e0 and a < 0.75e0)", wide="(a > 0.02e0 and a < 0.78e0)"),
    "p29_effect_color_weight": shown(EFFECT, weight="ew"),
    "p30_haze_suppression": shown(COLOURS, keep=px.haze_suppression()),
    "p31_white_ring_boost": shown(COLOURS, boost=px.white_ring_boost()),
    "p32_subject_confidence": shown(LAYERS, confidence="sc"),
    "p33_effect_layer": shown(EFFECT_LAYER, alpha="effect"),
    "p34_solid_layer": shown(COLOURS, alpha=one(SOLID), without_frame=pick("a >= 0.92e0", "a")),
    "p35_ai_solid_layer": shown(EFFECT, alpha=pick(AI_SOLID, "ai")),
    "p36_ai_subject_layer": shown(LAYERS, alpha=f"greatest({pick(AI_SOLID, 'ai')}, ai * {GATE})"),
    "p37_score_blocked_rescue": shown(
        EFFECT.let(support=smoothstep("a", 0.18, 0.38)),
        alpha=pick(f"{px.NON_SCREEN} and {px.SOFT_SUBJECT} and support > 0.1e0 and not {SOLID} and ew < 0.25e0 and not ({_rescue_blocked})", clip("a + 0.16e0 + 0.2e0 * support", 0.0, 0.72))),
    "p38_semantic_layer": shown(COLOURS, alpha=pick(px.NON_SCREEN, clip(f"0.82e0 * {smoothstep('ai', 0.25, 0.75)}", 0.0, 0.92))),
    "p39_black_effect_layer": shown(COLOURS, alpha=f"greatest(0.35e0 * {smoothstep('a', 0.03, 0.45)}, {pick(px.PURE_BLACK, '0e0', f'greatest({SMOKE_A}, {GLOW_A})')})"),
    "p40_ai_edge_blend": shown(PIXELS, alpha=pick("a > 0.1e0 and a < 0.9e0", "0.7e0 * a + 0.3e0 * ai", "a")),
    "p42_core_solidify": shown(LAYERS, alpha=pick("sc >= 0.8e0", "1e0", "a")),
    "p47_auto_downsample": table("part", "p_partkey", "p_size").select("p_partkey", ratio=rnd("least(512e0 / greatest(p_size * 40e0, p_size * 25e0), 1e0)")),
    "p48_legacy_merge": shown(EFFECT_LAYER, alpha=px.over(f"greatest({pick(AI_SOLID, 'ai')}, {one(SOLID)})", "effect * 0.7e0")),
    "f01_region_subject": MASKS.select(*KEYS, subject="subject"),
    "f02_region_transparent": MASKS.select(*KEYS, transparent="transparent"),
    "f03_region_uncertain": MASKS.select(*KEYS, uncertain="uncertain"),
    "f04_region_hair": MASKS.select(*KEYS, hair="hair"),
    "f07_region_classify_all": MASKS.select(*KEYS, "subject", "hair", "luminous", "transparent", "residue", "uncertain"),
    "f08_screen_green": COLOURS.select(*KEYS, non_screen=px.NON_SCREEN),
    "f09_solid_foreground": COLOURS.select(*KEYS, solid=px.SOLID_FOREGROUND),
    "f10_soft_subject": COLOURS.select(*KEYS, soft=px.SOFT_SUBJECT),
    "f11_smoke_mask": COLOURS.select(*KEYS, smoke=px.SMOKE),
    "f12_glow_mask": COLOURS.select(*KEYS, glow=px.GLOW),
    "f15_light_low_sat": COLOURS.select(*KEYS, light=px.LIGHT_LOW_SATURATION),
    "f16_swirl_color": COLOURS.select(*KEYS, swirl=px.SWIRL),
    "f18_gvm_fallback_mask": EFFECT.select(*KEYS, subject_like=(
        f"({px.NON_SCREEN} and {smoothstep('a', 0.30, 0.72)} > 0.35e0 and ({px.SOLID_FOREGROUND} or {px.SOFT_SUBJECT} or a >= 0.5e0)"
        f" and (ew < 0.35e0 or (({px.SOLID_FOREGROUND} or {px.SOFT_SUBJECT}) and a >= 0.45e0)))")),
    "f19_entity_effect_transition": LAYERS.let(gate=GATE).select(*KEYS, part="(case when gate >= 0.55e0 then 'entity' when ew >= 0.35e0 and gate <= 0.35e0 then 'effect' when a > 0.02e0 then 'transition' else 'none' end)"),
    "k10_preview_video": shown(PIXELS.let(bg=("(case when (y div 2 + x div 2) % 2 = 0 then 180e0 else 120e0 end)", "(case when (y // 2 + x // 2) % 2 = 0 then 180e0 else 120e0 end)")),
                               red="r * a + bg * (1e0 - a)", green="g * a + bg * (1e0 - a)", blue="b * a + bg * (1e0 - a)"),
    "k11_preview_frames": COLOURS.select(*KEYS, foreground="br > 10", screen="(g > 1.2e0 * r and g > 1.2e0 * b)"),
    "k16_overlay_region": MASKS.select(*KEYS, paint="(case when residue then 'residue' when luminous then 'luminous' when transparent then 'transparent' when hair then 'hair' when uncertain then 'uncertain' when subject then 'subject' else 'none' end)"),
    "u01_candidate_normalize": CANDIDATES.select(*KEYS, "candidate", alpha=rnd(clip("ca")), confidence=rnd(clip("cf")), given="(conf is not null)"),
}

"""Per-pixel expressions of the queries against the numpy rules, on random and on extreme colours."""

import numpy as np
import pytest

from alphaloom import api
from alphaloom.frames import rules
from alphaloom.frames.rules import Picture, clip, smoothstep

SHAPE = (40, 60)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(12)
    c = np.floor(rng.random((3, *SHAPE)) * 256)
    c[:, :8] = np.floor(np.clip(200 + rng.normal(0, 25, (3, 8, SHAPE[1])), 0, 255))  # pale
    c[1, 8:14] = np.clip(c[1, 8:14] + 120, 0, 255)  # green
    c[:, 14:18] = np.floor(rng.random((3, 4, SHAPE[1])) * 30)  # dark
    c[0, 18:24], c[1, 18:24], c[2, 18:24] = 210, np.floor(130 + rng.random((6, SHAPE[1])) * 60), np.floor(rng.random((6, SHAPE[1])) * 180)  # warm
    c[:, 24:28] = np.floor(40 + rng.random((3, 4, SHAPE[1])) * 12)  # smoke
    a, ai = rng.random(SHAPE), rng.random(SHAPE)
    a[::7], a[3::7], ai[::5] = 1.0, 0.0, 1.0
    flat = lambda x: [float(v) for v in np.ravel(x)]
    df = spark.createDataFrame([(1, 7, *SHAPE, *map(flat, (*c, a, ai)))], "clip int, frame_idx long, height int, width int, r array<double>, g array<double>, b array<double>, a array<double>, ai array<double>").cache()
    return df, Picture(*c), a, ai


def values(spark, scene, name, *columns):
    rows = api.run(name, spark, frames=scene[0]).toPandas()
    out = []
    for col in columns:
        m = np.full(SHAPE, np.nan, dtype=object)
        m[rows["y"], rows["x"]] = rows[col]
        out.append(m)
    return out


def haze(p):
    br, ch = p.brightness, p.chroma
    h = np.minimum.reduce([clip((p.g - p.b - 8) / 18), clip((p.g - p.r + 4) / 18), clip((br - 150) / 55), clip((95 - ch) / 95)])
    return clip(1 - h * (0.55 + 0.20 * np.maximum(clip((br - 175) / 55), clip((210 - ch) / 210))), 0.2, 1.0)


def ring(p, a):
    return 0.35 * np.minimum.reduce([clip((p.brightness - 175) / 45), clip((110 - p.chroma) / 110), clip((p.g - np.maximum(p.r, p.b)) / 55), clip(a / 0.28)])


def gate(p, a, ai):
    return smoothstep(rules.subject_confidence(p, ai, a), 0.45, 0.80)


NUMBERS = [
    ("p02_smoothstep", ("ramp", "step"), lambda p, a, ai: (smoothstep(a, 0.08, 0.75), (a >= 0.5).astype(float))),
    ("p03_brightness_chroma", ("brightness", "chroma", "saturation"), lambda p, a, ai: (p.brightness, p.chroma, p.saturation)),
    ("p04_rgb_to_hsv", ("hue", "sat", "val"), lambda p, a, ai: rules.hsv_of(p.r, p.g, p.b)),
    ("p05_to_gray", ("gray",), lambda p, a, ai: (np.floor(0.299 * p.r + 0.587 * p.g + 0.114 * p.b + 0.5) / 255,)),
    ("p12_soft_over", ("alpha",), lambda p, a, ai: (a + ai * (1 - a),)),
    ("p18_green_despill", ("red", "green", "blue"), lambda p, a, ai: rules.despilled(p, a)),
    ("p29_effect_color_weight", ("weight",), lambda p, a, ai: (p.effect,)),
    ("p30_haze_suppression", ("keep",), lambda p, a, ai: (haze(p),)),
    ("p31_white_ring_boost", ("boost",), lambda p, a, ai: (ring(p, a),)),
    ("p32_subject_confidence", ("confidence",), lambda p, a, ai: (rules.subject_confidence(p, ai, a),)),
    ("p33_effect_layer", ("alpha",), lambda p, a, ai: (rules.effect_layer(p, a),)),
    ("p34_solid_layer", ("alpha", "without_frame"), lambda p, a, ai: (rules.solid_layer(p, a), np.where(a >= 0.92, a, 0.0))),
    ("p35_ai_solid_layer", ("alpha",), lambda p, a, ai: (rules.ai_solid_layer(p, ai, a),)),
    ("p36_ai_subject_layer", ("alpha",), lambda p, a, ai: (np.maximum(rules.ai_solid_layer(p, ai, a), ai * gate(p, a, ai)),)),
    ("p38_semantic_layer", ("alpha",), lambda p, a, ai: (np.where(p.screen, 0.0, clip(0.82 * smoothstep(ai, 0.25, 0.75), 0, 0.92)),)),
    ("p40_ai_edge_blend", ("alpha",), lambda p, a, ai: (np.where((a > 0.1) & (a < 0.9), 0.7 * a + 0.3 * ai, a),)),
    ("p48_legacy_merge", ("alpha",), lambda p, a, ai: ((lambda s, e: clip(s + e * (1 - s)))(np.maximum(rules.ai_solid_layer(p, ai, a), rules.solid_layer(p, a)), rules.effect_layer(p, a) * 0.7),)),
    ("p39_black_effect_layer", ("alpha",), lambda p, a, ai: (np.maximum(0.35 * smoothstep(a, 0.03, 0.45), np.where(rules.black_masks(p)["black"], 0.0, np.maximum(
        np.maximum(clip((p.brightness - 4) / 48) * 0.30, 0.08) * rules.black_masks(p)["smoke"],
        np.maximum(0.30, 0.78 * np.maximum(smoothstep(p.brightness / 255, 0.08, 0.55), smoothstep(p.saturation, 0.08, 0.45))) * rules.black_masks(p)["glow"]))),)),
]
MASKS = [
    ("f08_screen_green", ("non_screen",), lambda p, a, ai: (~p.screen,)),
    ("f09_solid_foreground", ("solid",), lambda p, a, ai: (p.solid,)),
    ("f10_soft_subject", ("soft",), lambda p, a, ai: (rules.soft_subject(p),)),
    ("f11_smoke_mask", ("smoke",), lambda p, a, ai: (rules.black_masks(p)["smoke"],)),
    ("f12_glow_mask", ("glow",), lambda p, a, ai: (rules.black_masks(p)["glow"],)),
    ("f15_light_low_sat", ("light",), lambda p, a, ai: ((p.brightness >= 180) & (p.chroma <= 35),)),
    ("f16_swirl_color", ("swirl",), lambda p, a, ai: (p.swirl,)),
    ("f18_gvm_fallback_mask", ("subject_like",), lambda p, a, ai: (rules.fallback_mask(p, a),)),
    ("f28_gate_region_masks", ("uncertain_edge",), lambda p, a, ai: ((a > 0.02) & (a < 0.98) & ~((a >= 0.9) | (ai >= 0.9) | (a <= 0.01)),)),
    ("p28_transparency_band", ("band", "wide"), lambda p, a, ai: ((a > 0.02) & (a < 0.75), (a > 0.02) & (a < 0.78))),
]


@pytest.mark.parametrize("name, columns, rule", NUMBERS, ids=[x[0] for x in NUMBERS])
def test_numbers(spark, scene, name, columns, rule):
    _, p, a, ai = scene
    for got, want in zip(values(spark, scene, name, *columns), rule(p, a, ai)):
        assert np.allclose(got.astype(float), want, atol=2e-6), name


@pytest.mark.parametrize("name, columns, rule", MASKS, ids=[x[0] for x in MASKS])
def test_masks(spark, scene, name, columns, rule):
    _, p, a, ai = scene
    for got, want in zip(values(spark, scene, name, *columns), rule(p, a, ai)):
        assert (got.astype(bool) == want).all(), name


def test_parts(spark, scene):
    _, p, a, ai = scene
    part, = values(spark, scene, "f19_entity_effect_transition", "part")
    g = gate(p, a, ai)
    want = np.where(g >= 0.55, "entity", np.where((p.effect >= 0.35) & (g <= 0.35), "effect", np.where(a > 0.02, "transition", "none")))
    assert (part == want).all()

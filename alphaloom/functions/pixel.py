"""Per-pixel expressions: keying, layers, masks and colour correction as SQL text.

Every function returns an expression over the columns of a pixel table (r, g, b on 0..255,
a on 0..1, br = mean, ch = max - min) in the dialect both engines read. Nothing here is a
UDF: the expressions stay within whole-stage code generation.
"""

from __future__ import annotations


def clip(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"greatest({lo!r}e0, least({hi!r}e0, {x}))"


def smoothstep(x: str, lo: float, hi: float) -> str:
    """t * t * (3 - 2 t) of the clipped ramp; a step where hi <= lo."""
    if hi <= lo:
        return f"(case when {x} >= {hi}e0 then 1e0 else 0e0 end)"
    t = clip(f"({x} - {lo}e0) / {round(hi - lo, 10)}e0")
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def one(cond: str) -> str:
    return f"(case when {cond} then 1e0 else 0e0 end)"


def pick(cond: str, x: str, other: str = "0e0") -> str:
    return f"(case when {cond} then {x} else {other} end)"


# Colour classes of pixels.
SCREEN_GREEN = "(g > r + 30 and g > b + 20 and g > 90)"
NON_SCREEN = f"(not {SCREEN_GREEN})"
SOLID_FOREGROUND = f"({NON_SCREEN} and ((br > 155 and ch < 90) or (r > g + 45 and b > g + 15 and br > 135)))"
SOFT_SUBJECT = f"({NON_SCREEN} and abs(r - g) < 45 and abs(b - g) < 45 and ((br > 165 and ch < 75) or (br > 150 and br < 190 and ch < 45 and b >= r - 5)))"
WARM_SHELL = f"(r > 170 and g > 115 and b < 175 and r - b > 45 and g - b > 8 and {NON_SCREEN})"
BRIGHT_CORE = f"(br > 165 and r > 190 and g > 145 and b > 70 and {NON_SCREEN})"
LIGHT_LOW_SATURATION = "(br >= 180 and ch <= 35)"
SATURATION = "(case when mx > 0 then ch / (mx + 1e-6) else 0e0 end)"
PURE_BLACK = "(br <= 3.1875e0)"
SMOKE = f"((not {PURE_BLACK}) and br >= 14 and br <= 64 and ch <= 14 and {SATURATION} <= 0.28e0)"
GLOW = f"((not {PURE_BLACK}) and ((br >= 48 and ch >= 28 and {SATURATION} >= 0.18e0) or (br >= 112 and ch <= 34)))"
UNCERTAIN = "(a > 0.05e0 and a < 0.95e0)"
SWIRL = "(b > g + 8 or (r > g + 8 and b > g + 4) or (br > 150 and ch < 70 and g < 205))"


def effect_weight() -> str:
    """Pink glow or white glow, the latter discounted by green haze."""
    pink = f"{clip('(r - g - 20) / 45e0')} * {clip('(b - g + 5) / 45e0')}"
    haze = f"least({clip('(g - b - 10) / 18e0')}, {clip('(g - r + 2) / 14e0')}, {clip('(br - 165) / 40e0')}, {clip('(85 - ch) / 85e0')})"
    white = f"{clip('(br - 185) / 50e0')} * {clip('(90 - ch) / 90e0')} * (1e0 - 0.85e0 * {haze})"
    return f"greatest({pink}, {white})"


def haze_suppression() -> str:
    haze = f"least({clip('(g - b - 8) / 18e0')}, {clip('(g - r + 4) / 18e0')}, {clip('(br - 150) / 55e0')}, {clip('(95 - ch) / 95e0')})"
    bias = f"greatest({clip('(br - 175) / 55e0')}, {clip('(210 - ch) / 210e0')})"
    return clip(f"1e0 - {haze} * (0.55e0 + 0.2e0 * {bias})", 0.2, 1.0)


def white_ring_boost(alpha: str = "a") -> str:
    return f"0.35e0 * least({clip('(br - 175) / 45e0')}, {clip('(110 - ch) / 110e0')}, {clip('(g - greatest(r, b)) / 55e0')}, {clip(f'{alpha} / 0.28e0')})"


def subject_confidence(ai: str = "ai", base: str = "a") -> str:
    """Share of a subject in an AI alpha: affine in its support, discounted where the colour looks like an effect."""
    support = smoothstep(base, 0.08, 0.42)
    either = one(f"{SOLID_FOREGROUND} or {SOFT_SUBJECT}")
    raw = f"(0.08e0 + 0.58e0 * {smoothstep(ai, 0.45, 0.92)} + 0.18e0 * {support} + 0.1e0 * {one(NON_SCREEN)} + 0.1e0 * {either})"
    return clip(f"{raw} * (1e0 - 0.9e0 * ew * (1e0 - 0.75e0 * {support}) * (1e0 - 0.85e0 * {either} * {support}))")


def over(solid: str, effect: str) -> str:
    """Soft union of two layers."""
    return clip(f"{clip(solid)} + {clip(effect)} * (1e0 - {clip(solid)})")

"""DuckDB SQL for neighbourhood rules on the 8 x 8 view, written by hand: what the frame kernels' queries are held against.

Nothing here is shared with the kernels but element and kernel tables: neighbours are found by joins of
pixel rows, components by recursion.
"""

from __future__ import annotations

from alphaloom.frames.grid import ellipse, gaussian_kernel, square
from alphaloom.functions import pixel as px
from alphaloom.plans.views import MASKS, PIXELS

KEYS = "clip, frame_idx, y, x"
CROSS = ellipse(3)


def rnd(x: str) -> str:
    return f"round({x} + 1e-9, 6) + 0e0"


def query(final: str, **steps: str) -> str:
    """Named steps over px (pixel rows with brightness and chroma), then the final select."""
    first = f"SELECT *, (r + g + b) / 3e0 AS br, greatest(r, g, b) - least(r, g, b) AS ch, greatest(r, g, b) AS mx FROM ({PIXELS.sql()})"
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in {"px": first, **steps}.items()) + " " + final


def near(source: str, element: list[tuple[int, int]], **values: str) -> str:
    """Own keys and aggregates over the neighbours n in an element, as far as they lie in the frame."""
    widths = " ".join(f"WHEN {dy} THEN {w}" for dy, w in element if abs(dy) < 8)
    told = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return (f"SELECT p.clip, p.frame_idx, p.y, p.x, {told} FROM {source} p JOIN {source} n ON n.clip = p.clip AND n.frame_idx = p.frame_idx "
            f"AND abs(n.x - p.x) <= (CASE n.y - p.y {widths} ELSE -1 END) GROUP BY p.clip, p.frame_idx, p.y, p.x")


def filtered(source: str, weights: dict[tuple[int, int], float], column: str, name: str, border: str = "mirror") -> str:
    """A weighted sum over offsets, with mirrored or repeated borders."""
    at = (lambda v: f"7 - abs(7 - abs({v}))") if border == "mirror" else (lambda v: f"least(7, greatest(0, {v}))")
    told = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for (dy, dx), w in weights.items())
    total = f"sum(o.w * n.{column})" if border == "mirror" else f"quantile_disc(n.{column}, 0.5)"
    return (f"SELECT p.clip, p.frame_idx, p.y, p.x, {total} AS {name} FROM {source} p CROSS JOIN (VALUES {told}) AS o(dy, dx, w) JOIN {source} n ON n.clip = p.clip AND n.frame_idx = p.frame_idx "
            f"AND n.y = {at('p.y + o.dy')} AND n.x = {at('p.x + o.dx')} GROUP BY p.clip, p.frame_idx, p.y, p.x")


def gauss(size: int) -> dict[tuple[int, int], float]:
    k, r = [float(x) for x in gaussian_kernel(size)], size // 2
    return {(y, x): k[y + r] * k[x + r] for y in range(-r, r + 1) for x in range(-r, r + 1)}


def ones(size: int) -> dict[tuple[int, int], float]:
    r = size // 2
    return {(y, x): 1.0 for y in range(-r, r + 1) for x in range(-r, r + 1)}


def joined(first: str, *others: str) -> str:
    return f"SELECT * FROM {first} " + " ".join(f"JOIN {o} USING ({KEYS})" for o in others)


#: The pointwise parts of the region masks.
MASKED = f"SELECT {KEYS}, subject, hair, luminous, transparent, residue, uncertain FROM ({MASKS.sql()})"


def opened_closed(source: str) -> dict[str, str]:
    """Steps e1 to e4 of an opening and a closing of u8 by a cross; the last column is oc."""
    return {"e1": near(source, CROSS, u8="min(n.u8)"), "e2": near("e1", CROSS, u8="max(n.u8)"), "e3": near("e2", CROSS, u8="max(n.u8)"), "e4": near("e3", CROSS, oc="min(n.u8)")}


def grown_blurred(source: str) -> dict[str, str]:
    """Steps g1 and g2 of u8: dilated by a cross, then blurred and rounded; the last column is gb."""
    return {"g1": near(source, CROSS, u8="max(n.u8)"), "g2": f"SELECT {KEYS}, floor(s + 0.5e0) AS gb FROM ({filtered('g1', gauss(3), 'u8', 's')})"}


def despeckle(size: int = 5, masked: bool = False) -> dict[str, str]:
    """Steps to dk(alpha, back): the median of a square, supported soft alphas put back, and with masks transparent and luminous cells."""
    enough = max(4, size * size // 12)
    back = "u8 > 8 AND med <= 8 AND (supported" + (" OR transparent)" if masked else ")")
    clean = f"CASE WHEN {back} THEN u8 ELSE med END"
    return {"u": f"SELECT {KEYS}, floor(a * 255e0) AS u8 FROM px", "m1": filtered("u", ones(size), "u8", "med", "repeat"),
            "m2": near("u", square(size), supported=f"count(CASE WHEN n.u8 > 8 THEN 1 END) >= {enough}"), "mk": MASKED, "mj": joined("u", "m1", "m2", "mk"),
            "dk": f"SELECT {KEYS}, ({back}) AS back, " + (f"(CASE WHEN luminous THEN greatest({clean}, u8) ELSE {clean} END)" if masked else f"({clean})") + " / 255e0 AS alpha, a0 FROM (SELECT *, u8 / 255e0 AS a0 FROM mj)"}


def black(base: str = "a") -> dict[str, str]:
    """Steps to bk: enhanced alpha, effect and masks on black for a base alpha, a column of px."""
    sat = "(CASE WHEN mx > 0 THEN ch / (mx + 1e-6) ELSE 0e0 END)"
    smooth = lambda x, lo, hi: f"(CASE WHEN true THEN (least(1e0, greatest(0e0, ({x} - {lo}e0) / {hi - lo!r}e0))) ELSE 0e0 END)"
    step = lambda x, lo, hi: f"({smooth(x, lo, hi)} * {smooth(x, lo, hi)} * (3e0 - 2e0 * {smooth(x, lo, hi)}))"
    return {
        "b0": f"SELECT {KEYS}, {base} AS base, br, ch, {sat} AS sat, r + g + b AS s, floor(br) AS whole, br <= 3.1875e0 AS black, ({base} >= 0.75e0) AS solid FROM px",
        "b1": near("b0", square(3), top="max(n.whole)", reach="bool_or(n.solid)"), "b2": filtered("b0", ones(3), "s", "around"), "b3": filtered("b0", gauss(3), "base", "soft"),
        "b4": "SELECT *, NOT black AND br >= 14 AND br <= 64 AND ch <= 14 AND sat <= 0.28e0 AS smoke, NOT black AND ((br >= 48 AND ch >= 28 AND sat >= 0.18e0) OR (br >= 112 AND ch <= 34)) AS glow, "
        "NOT black AND br >= 8 AND whole = top AND 9 * s - around >= 162 AS particle, reach AND base > 0.02e0 AND base < 0.75e0 AS edge FROM (" + joined("b0", "b1", "b2", "b3") + ")",
        "b5": f"SELECT *, greatest((CASE WHEN smoke THEN greatest(least(1e0, greatest(0e0, (br - 4) / 48e0)) * 0.3e0, 0.08e0) ELSE 0e0 END), (CASE WHEN glow THEN greatest(0.3e0, 0.78e0 * greatest({step('br / 255e0', 0.08, 0.55)}, {step('sat', 0.08, 0.45)})) ELSE 0e0 END), "
        f"(CASE WHEN particle THEN greatest(0.18e0, 0.52e0 * {step('br / 255e0', 0.02, 0.20)}) ELSE 0e0 END)) AS eff FROM b4",
        "bk": "SELECT *, (CASE WHEN black AND base <= 0.01e0 THEN 0e0 ELSE least(1e0, greatest(base, eff, CASE WHEN edge THEN greatest(base, 0.72e0 * soft) ELSE 0e0 END)) END) AS alpha, (CASE WHEN black THEN 0e0 ELSE eff END) AS effect FROM b5"}


def shown(source: str, **cols: str) -> str:
    return f"SELECT {KEYS}, {', '.join(f'{rnd(e)} AS {k}' for k, e in cols.items())} FROM {source}"


WARM = "(r > 170 AND g > 115 AND b < 175 AND r - b > 45 AND g - b > 8)"
SCREEN = px.SCREEN_GREEN

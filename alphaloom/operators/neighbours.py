"""Relational forms of neighbourhood rules on the 8 x 8 view: the SQL that the frame kernels' queries are held against.

Only their SQL is used; the queries themselves run by the kernels (framed.py), on frames of any size.
"""

from __future__ import annotations

from alphaloom.functions import pixel as px
from alphaloom.operators.points import KEYS, rnd, shown
from alphaloom.plans.relation import Relation, rows, table
from alphaloom.plans.views import COLOURS, MASKS, PIXELS, _on

SIDE = 8

# Structuring elements as (dy, dx). The 3 x 3 ellipse is a cross; the 5 x 5 one has rows of 1, 5, 5, 5, 1.
SQUARE3 = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
CROSS3 = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
ELLIPSE5 = [(-2, 0), *[(y, x) for y in (-1, 0, 1) for x in range(-2, 3)], (2, 0)]


#: (clip, frame_idx, alphas, brights): frames as arrays in row order.
PACKED: Relation = table("embeddings", "vec_id", "embedding", "label").select(
    clip="label", frame_idx="vec_id",
    alphas=("transform(embedding, v -> greatest(0e0, least(1e0, 0.5e0 + 4e0 * cast(v as double))))", "list_transform(embedding, lambda v: greatest(0e0, least(1e0, 0.5e0 + 4e0 * v::DOUBLE)))"),
    brights=("transform(sequence(0, 63), p -> (" + " + ".join(_on("floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V)))", k)[0] for k in (0, 21, 42)) + ") / 3e0)",
             "list_transform(range(64), lambda p: (" + " + ".join(_on("floor(255e0 * greatest(0e0, least(1e0, 0.5e0 + 2e0 * V)))", k)[1] for k in (0, 21, 42)) + ") / 3e0)"))


def at(array: str, dy: int, dx: int, border: str = "null") -> tuple[str, str]:
    """The neighbour of cell p; border: null, zero, replicate or reflect."""
    py, pxx = ("(p div 8)", "(p // 8)"), ("(p % 8)", "(p % 8)")
    both = []
    for k, name in enumerate(("element_at({a}, cast({i} as int))", "{a}[({i})::INT]")):
        y, x = (f"({py[k]} + {dy})", f"({pxx[k]} + {dx})")
        if border == "replicate":
            y, x = f"least(7, greatest(0, {y}))", f"least(7, greatest(0, {x}))"
        elif border == "reflect":
            y, x = f"(7 - abs(7 - abs({y})))", f"(7 - abs(7 - abs({x})))"
        value = name.format(a=array, i=f"{y} * 8 + {x} + 1")
        if border in ("null", "zero"):
            value = f"(case when {y} between 0 and 7 and {x} between 0 and 7 then {value} else {'null' if border == 'null' else '0e0'} end)"
        both.append(value)
    return both[0], both[1]


def each(expr: tuple[str, str]) -> tuple[str, str]:
    """An expression of cell number p for all cells of a frame."""
    return f"transform(sequence(0, 63), p -> {expr[0]})", f"list_transform(range(64), lambda p: {expr[1]})"


def over(fn: str, array: str, element, border: str = "null") -> tuple[str, str]:
    parts = [at(array, dy, dx, border) for dy, dx in element]
    return tuple(f"{fn}({', '.join(p[k] for p in parts)})" for k in (0, 1))


def weighted(array: str, weights: dict[tuple[int, int], float], border: str = "reflect") -> tuple[str, str]:
    parts = [(w, at(array, dy, dx, border)) for (dy, dx), w in weights.items()]
    return tuple("(" + " + ".join(f"{w!r}e0 * {p[k]}" for w, p in parts) + ")" for k in (0, 1))


def me(template: str) -> tuple[str, str]:
    """A template over own cells: names in braces become the cell's element of that array."""
    import re

    return tuple(re.sub(r"\{(\w+)\}", lambda m: at(m[1], 0, 0)[k], template) for k in (0, 1))


def dilate(array: str, element) -> tuple[str, str]:
    return each(over("greatest", array, element))


def erode(array: str, element) -> tuple[str, str]:
    return each(over("least", array, element))


GAUSS3 = {(y, x): (0.25, 0.5, 0.25)[y + 1] * (0.25, 0.5, 0.25)[x + 1] for y in (-1, 0, 1) for x in (-1, 0, 1)}


def cells(rel: Relation, **cols: str) -> Relation:
    """One row a cell: keys, and elements of arrays (name = array) or expressions in braces."""
    return rel.explode("p", ("sequence(0, 63)", "range(64)")).select(
        "clip", "frame_idx", y=("cast(p div 8 as int)", "(p // 8)::INT"), x=("cast(p % 8 as int)", "(p % 8)::INT"),
        **{k: me(e if "{" in e else "{" + e + "}") for k, e in cols.items()})


# --- connected components


def components(cells_: Relation, cond: str) -> Relation:
    """(clip, frame_idx, y, x, label) of the cells for which cond holds."""
    mask = cells_.where(cond).select(*KEYS)

    def text() -> str:
        return (f"WITH RECURSIVE m AS ({mask.sql()}), cc AS (SELECT clip, frame_idx, y, x, y * {SIDE} + x AS label FROM m UNION "
                "SELECT m.clip, m.frame_idx, m.y, m.x, cc.label FROM cc JOIN m ON cc.clip = m.clip AND cc.frame_idx = m.frame_idx AND abs(cc.y - m.y) <= 1 AND abs(cc.x - m.x) <= 1) "
                "SELECT clip, frame_idx, y, x, min(label)::INT AS label FROM cc GROUP BY clip, frame_idx, y, x")

    return Relation(lambda spark, sf_dir: mask.frame(spark, sf_dir), text)


def sized(cc: Relation, having: str) -> Relation:
    """Cells of the components whose area n fulfils a condition."""
    keep = cc.agg("clip frame_idx label", n="count(*)").where(having).select("clip", "frame_idx", "label", area="n")
    return cc.join(keep, "clip frame_idx label").select(*KEYS, "label", "area")


SOLID95 = PACKED.let(solid=each(me("(case when {alphas} >= 0.95e0 then 1e0 else 0e0 end)")))
EDGE = cells(SOLID95.let(near=dilate("solid", CROSS3)), a="alphas", edge="({alphas} > 0.05e0 and {alphas} < 0.95e0 and {near} = 1)")
SPECKLE = sized(components(EDGE, "a > 0.03e0 and a < 0.95e0 and not edge"), "n <= 12")
FG = PACKED.let(fg=each(me("(case when {alphas} >= 0.7e0 then 1e0 else 0e0 end)"))).let(grown=dilate("fg", ELLIPSE5))
CLOSED = cells(FG.let(closed=erode("grown", ELLIPSE5)), a="alphas", hole="({closed} = 1 and {fg} = 0)", fg="({fg} = 1)")
HOLE = sized(components(CLOSED, "hole"), "n >= 5")
RESIDUE = sized(components(MASKS, "residue"), "n >= 3")
WARM = sized(components(COLOURS.let(warm=f"(a >= 0.6e0 and {px.WARM_SHELL})"), "warm"), "n >= 3")
SUBJECT_EDGE = PACKED.let(solid=each(me("(case when {alphas} >= 0.75e0 then 1e0 else 0e0 end)"))).let(reach=dilate("solid", SQUARE3), blur=each(weighted("alphas", GAUSS3)))
ON_EDGE = "({reach} = 1 and {alphas} > 0.02e0 and {alphas} < 0.75e0)"
SOLID7 = components(PIXELS, "a >= 0.7e0")

FORMS: dict[str, Relation] = {
    "n01": EDGE.where("edge").select(*KEYS),
    "n02": SPECKLE,
    "n03": HOLE,
    "n04": sized(SOLID7, "n <= 6"),
    "n05": sized(SOLID7, "n >= 7"),
    "n13": shown(cells(SUBJECT_EDGE, alpha=f"(case when {ON_EDGE} then greatest({{alphas}}, 0.72e0 * {{blur}}) else 0e0 end)"), alpha="alpha"),
    "f05": RESIDUE,
    "f14": cells(SUBJECT_EDGE, edge=ON_EDGE),
    "f23": shown(PIXELS.join(WARM.select(*KEYS), "clip frame_idx y x"), alpha="greatest(a, 0.98e0)"),
    "k15": EDGE.select(*KEYS, "edge").join(SPECKLE.select(*KEYS, speckle="true"), "clip frame_idx y x", "left").join(HOLE.select(*KEYS, hole="true"), "clip frame_idx y x", "left").select(
        *KEYS, paint="(case when hole then 'hole' when speckle then 'speckle' when edge then 'edge' else 'none' end)"),
    "a38": SOLID7.join(PIXELS, "clip frame_idx y x").agg("clip frame_idx label", n="count(*)", total=rnd("sum(a)")),
    "j07": SOLID7.join(SOLID7.join(PIXELS.where("a >= 0.999e0").select(*KEYS), "clip frame_idx y x", "semi").select("clip", "frame_idx", "label"), "clip frame_idx label", "semi").select(*KEYS, "label"),
}

#: Queries on single cells that need no kernel.
SPEC = rows("clip int, top int, left_ int, height int, width int", (0, 2, 1, 4, 4), (1, 0, 0, 3, 5), (3, 4, 2, 4, 6), (7, 1, 1, 2, 2))
OPS: dict[str, Relation] = {
    "n17_known_crop": PIXELS.join(SPEC, "clip").where("y >= top and y < top + height and x >= left_ and x < left_ + width").select(*KEYS, alpha=rnd("a")),
}

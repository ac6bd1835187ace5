"""Queries by the frame kernels: neighbourhood, refinement, colour and selection rules over FRAMES, of any size, without a shuffle.

Each query names its kernel and the SQL that the test data's 8 x 8 frames are held against; that SQL is
written apart from the kernel (alphaloom.plans.grid_sql, or the relational forms in neighbours.FORMS).
Queries without SQL need topology or statistics that SQL can't say; tests hold these against plain loops.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.frames import api, grid, rules
from alphaloom.frames.api import Frame
from alphaloom.operators.aggregates import FORMS as AGGREGATES
from alphaloom.operators.neighbours import FORMS
from alphaloom.operators.points import DESPILLED, KEYED
from alphaloom.plans import grid_sql as gs
from alphaloom.plans.relation import Relation
from alphaloom.plans.views import CANDIDATES, FRAMES

COLOURS = ("r", "g", "b")
REGIONS = rules.REGIONS
#: What the region masks are called in the views.
VIEWED = dict(zip(REGIONS, ("subject", "hair", "luminous", "transparent", "residue", "uncertain")))
BOOLS = ", ".join(f"{k} array<boolean>" for k in REGIONS)


def plain_regions(f: Frame, alpha: str = "a") -> dict[str, np.ndarray]:
    """The pointwise parts of the region masks: without reach, filling and least areas, which frames of 8 x 8 don't have."""
    p, a = f.picture, f[alpha]
    bright = (p.brightness > 165) & (p.r > 190) & (p.g > 145) & (p.b > 70) & ~p.screen
    lum = p.warm & ~p.screen | bright
    clear = (a > 0.08) & (a < 0.82) & (p.brightness > 135) & (p.chroma < 120) & ~p.screen & ~lum
    soft = (a > 0.05) & (a < 0.95)
    rest = (a > 0.35) & (p.brightness > 175) & (p.chroma < 45) & ~lum & ~clear & ~((a >= 0.88) & (p.brightness > 175) & (p.chroma < 70) & ~p.screen)
    return {"subject": (a >= 0.7) & ~rest, "hair_edge": soft & (p.brightness > 80) & (p.chroma < 180) & ~lum, "luminous_prop": lum, "transparent_effect": clear, "background_residue": rest, "uncertain_edge": soft}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FRAMES.frame(spark, sf_dir)


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with region masks: the whole rules where the caller bound frames, on the view's small ones their pointwise parts."""
    d = frames(spark, sf_dir)
    return api.per_frame(d, lambda f: plain_regions(f) if f.shape == (8, 8) else rules.ownership(f.picture, f["a"]), BOOLS, "a", *COLOURS, keep=tuple(d.columns))


def _six(c):
    return F.round(c + 1e-9, 6) + 0.0


def pixels(rule: Callable[[Frame], dict], need: tuple[str, ...], sql: str | Relation | None, where: str | None = None, **out: str) -> Relation:
    """A query of one row a cell: the kernel's arrays (out: name = type; doubles are shown with six digits), as far as `where` holds."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = api.per_frame(frames(spark, sf_dir), rule, ", ".join([*(f"{k} array<{t}>" for k, t in out.items()), *([] if where is None else ["keep_ array<boolean>"])]), *need)
        d = api.cells(d, *out, *([] if where is None else ["keep_"]))
        d = d if where is None else d.where("keep_")
        return d.select(*api.KEYS, "y", "x", *[(_six(F.col(k)) if t == "double" else F.col(k)).alias(k) for k, t in out.items()])

    return Relation(build, (lambda: sql) if isinstance(sql, str) else sql.sql if sql is not None else lambda: "")


def query(build: Callable[[SparkSession, str], DataFrame], sql: str | Relation | None) -> Relation:
    return Relation(build, (lambda: sql) if isinstance(sql, str) else sql.sql if sql is not None else lambda: "")


def regions_of(f: Frame) -> dict[str, np.ndarray]:
    return plain_regions(f) if f.shape == (8, 8) else rules.ownership(f.picture, f["a"])


def _components(mask: Callable[[Frame], np.ndarray], need: tuple[str, ...], form: str, least: int = 1, most: int | None = None) -> Relation:
    """Cells of components between two areas, with the component's first cell (as its label) and area."""
    def rule(f: Frame) -> dict:
        labels, areas = grid.components(mask(f))
        first = np.zeros(len(areas), int)
        seen, at = np.unique(labels.ravel(), return_index=True)
        first[seen] = at
        ok = (areas >= least) & (areas <= most if most is not None else True)
        ok[0] = False
        return {"label": first[labels], "area": areas[labels], "keep_": ok[labels]}

    return pixels(rule, need, FORMS[form], "keep_", label="int", area="bigint")


def _where(mask: Callable[[Frame], np.ndarray], need: tuple[str, ...], sql) -> Relation:
    """Keys of the cells of a mask."""
    return pixels(lambda f: {"keep_": mask(f)}, need, sql, "keep_", **{})


def _alpha(rule: Callable[[Frame], np.ndarray], need: tuple[str, ...], sql, name: str = "alpha") -> Relation:
    return pixels(lambda f: {name: rule(f)}, need, sql, None, **{name: "double"})


def _mask(rule: Callable[[Frame], np.ndarray], need: tuple[str, ...], sql, name: str) -> Relation:
    return pixels(lambda f: {name: rule(f)}, need, sql, None, **{name: "boolean"})


def _colours(rule: Callable[[Frame], list[np.ndarray]], sql, n: int = 3) -> Relation:
    names = ("red", "green", "blue")[:n]
    return pixels(lambda f: dict(zip(names, rule(f))), ("a", *COLOURS), sql, None, **dict.fromkeys(names, "double"))


A, ALL, BOTH = ("a",), ("a", *COLOURS), ("a", "ai", *COLOURS)
_U = f"SELECT {gs.KEYS}, floor(a * 255e0) AS u8 FROM px"
_SOFT = "a > 0.05e0 AND a < 0.95e0"


def _blurred(size: int) -> dict[str, str]:
    return {"u": _U, "bl": f"SELECT {gs.KEYS}, floor(s + 0.5e0) / 255e0 AS blur FROM ({gs.filtered('u', gs.gauss(size), 'u8', 's')})"}


_TRI = {"t0": f"SELECT {gs.KEYS}, a, a > 0.02e0 AND a < 0.98e0 AS soft, a >= 0.95e0 AS fg, a <= 0.05e0 AS bg FROM px", "t1": gs.near("t0", gs.CROSS, grown="bool_or(n.soft)"),
        "t2": gs.near("t0", gs.ellipse(5), sides="bool_or(n.fg) AND bool_or(n.bg)"), "tri": f"SELECT {gs.KEYS}, a, (CASE WHEN grown OR sides THEN 128 WHEN fg THEN 255 WHEN bg THEN 0 ELSE 128 END) AS trimap FROM ({gs.joined('t0', 't1', 't2')})"}
_REFINED = {**_TRI, **_blurred(9), "mk": gs.MASKED,
            "rf": f"SELECT *, (CASE WHEN luminous OR transparent THEN greatest(fresh, a) ELSE fresh END) AS alpha FROM (SELECT *, (CASE WHEN redo THEN blur ELSE a END) AS fresh FROM (SELECT *, trimap = 128 AND (hair OR uncertain) AND NOT (luminous OR transparent) AS redo FROM ({gs.joined('tri', 'bl', 'mk')})))"}
_DESPILLED = {"ds": f"SELECT {gs.KEYS}, a, r, g, b, rc, gc, bc FROM ({DESPILLED.sql()})"}
_KEY = {"ky": f"SELECT {gs.KEYS}, floor(alpha * 255e0) AS u8, max(floor(alpha * 255e0)) OVER w AS hi, min(floor(alpha * 255e0)) OVER w AS lo FROM ({KEYED.sql()}) WINDOW w AS (PARTITION BY clip, frame_idx)", **gs.opened_closed("ky"),
        "kc": f"SELECT {gs.KEYS}, (CASE WHEN hi > 0 AND lo < 255 THEN oc ELSE ky.u8 END) AS u8 FROM ky JOIN e4 USING ({gs.KEYS})"}
_KEYED = gs.query(gs.shown("kc", alpha="u8 / 255e0"), **_KEY)
_BASE11 = {"k0": f"SELECT {gs.KEYS}, floor((CASE WHEN br >= 60 THEN 1e0 WHEN br > 45 THEN (br - 45) / 15e0 * 0.75e0 ELSE 0e0 END) * 255e0) AS u8 FROM px", "k1": f"SELECT {gs.KEYS}, floor(s + 0.5e0) / 255e0 AS kb FROM ({gs.filtered('k0', gs.gauss(3), 'u8', 's')})"}
_BLACK11 = {"kp": f"SELECT px.*, kb FROM px JOIN k1 USING ({gs.KEYS})"}


def _on(steps: dict[str, str], source: str) -> dict[str, str]:
    return {k: v.replace("FROM px", f"FROM {source}") for k, v in steps.items()}


_HALO = {"h0": f"SELECT *, ((br > 205 AND ch < 70) OR (br > 185 AND b > 150 AND g > 140 AND r > 130 AND ch < 95) OR (r > 200 AND g > 155 AND b > 90 AND br > 165)) AND NOT {gs.SCREEN} AS core FROM px",
         "h1": gs.near("h0", gs.ellipse(25), reach="bool_or(n.core)", dist="min(CASE WHEN n.core THEN sqrt((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x)) END)")}
_RAMP = "least(1e0, greatest(0e0, (br / 255e0 - 0.42e0) / 0.3e0))"
_WARM = {"w0": f"SELECT *, {gs.WARM} AS warm, ({gs.WARM} OR (r > 110 AND g > 100 AND b < 130 AND r - b > 35 AND g - b > 35 AND g - r < 55)) AND NOT {gs.SCREEN} AND a > 0.2e0 AS seed FROM px"}


def ladder(f: Frame) -> dict:
    return {"keep_": rules.screen_pixels(f.picture, f["a"]), "red": f["r"], "green": f["g"], "blue": f["b"]}


_LADDER = gs.query(
    f"SELECT {gs.KEYS}, {gs.rnd('r')} AS red, {gs.rnd('g')} AS green, {gs.rnd('b')} AS blue FROM s2 WHERE CASE WHEN n1 >= 16 THEN s1 WHEN n2 >= 16 THEN m2 WHEN n3 >= 16 THEN m3 ELSE false END",
    s0="SELECT *, (y = 0 OR y = 7 OR x = 0 OR x = 7) AS border, g > r + 12 AND g > b + 12 AS like_ FROM px", s_="SELECT *, border AND a <= 0.04e0 AND like_ AS s1, a <= 0.06e0 AND like_ AS m2, border AND like_ AS m3 FROM s0",
    s2="SELECT *, count(CASE WHEN s1 THEN 1 END) OVER w AS n1, count(CASE WHEN m2 THEN 1 END) OVER w AS n2, count(CASE WHEN m3 THEN 1 END) OVER w AS n3 FROM s_ WINDOW w AS (PARTITION BY clip, frame_idx)")


def _p(f: Frame):
    return f.picture


def enhanced(f: Frame) -> dict:
    return {"alpha": rules.black_enhanced(_p(f), f["a"])[0]}


def _swirl_sql() -> str:
    s = "(b > g + 8 OR (r > g + 8 AND b > g + 4) OR (br > 150 AND ch < 70 AND g < 205))"
    return gs.query(gs.shown(f"(SELECT {gs.KEYS}, (CASE WHEN {s} AND a < 0.42e0 AND top / 255e0 > 0.45e0 THEN greatest(a, least(0.55e0, top / 255e0 * 0.58e0)) ELSE a END) AS v FROM px JOIN d USING ({gs.KEYS}))", alpha="v"),
                    u=_U, d=gs.near("u", gs.square(9), top="max(n.u8)"))


# --- by clip


def black_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.per_frame(frames(spark, sf_dir), lambda f: rules.black_enhanced(_p(f), f["a"])[2], "smoke long, glow long, particle long, subject_edge long, black long, mean_delta double", *ALL)
    return d.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), *[F.sum(k).alias(k) for k in ("smoke", "glow", "particle", "subject_edge", "black")], _six(F.avg("mean_delta")).alias("mean_delta"))


_BLACK_HISTORY = gs.query(
    f"SELECT clip, count(*) AS frames, sum(smoke)::BIGINT AS smoke, sum(glow)::BIGINT AS glow, sum(particle)::BIGINT AS particle, sum(subject_edge)::BIGINT AS subject_edge, sum(black)::BIGINT AS black, {gs.rnd('avg(d)')} AS mean_delta FROM (SELECT clip, frame_idx, "
    + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {k}" for k, c in (("smoke", "smoke"), ("glow", "glow"), ("particle", "particle"), ("subject_edge", "edge"), ("black", "black")))
    + ", coalesce(avg(CASE WHEN abs(alpha - base) > 1e-6 THEN abs(alpha - base) END), 0e0) AS d FROM bk GROUP BY clip, frame_idx) GROUP BY clip", **gs.black())


def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.per_frame(frames(spark, sf_dir), lambda f: rules.refined(f["a"], regions_of(f))[1], "changed long, guarded long, reconstructed long, mean_delta double", *ALL)
    return d.groupBy("clip").agg(F.sum("changed").alias("changed"), F.sum("guarded").alias("guarded"), _six(F.avg("mean_delta")).alias("mean_delta"))


_RECONSTRUCTION = gs.query(
    f"SELECT clip, sum(c)::BIGINT AS changed, sum(k)::BIGINT AS guarded, {gs.rnd('avg(d)')} AS mean_delta FROM (SELECT clip, frame_idx, count(CASE WHEN redo AND abs(alpha - a) > 1e-6 THEN 1 END) AS c, count(CASE WHEN luminous OR transparent THEN 1 END) AS k, "
    "coalesce(avg(CASE WHEN redo AND abs(alpha - a) > 1e-6 THEN abs(alpha - a) END), 0e0) AS d FROM rf GROUP BY clip, frame_idx) GROUP BY clip", **_REFINED)


def screen_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of all strict screen cells of a clip; pure green for a clip without any. Cells are counted by value before the median, so a clip sends at most 256 values a channel, whatever its size."""
    d = frames(spark, sf_dir)
    found = api.cells(api.per_frame(d, lambda f: {"keep_": rules.screen_pixels(_p(f), f["a"], strict=True), "r": f["r"], "g": f["g"], "b": f["b"]}, "keep_ array<boolean>, r array<double>, g array<double>, b array<double>", *ALL), "keep_", *COLOURS).where("keep_")
    counts = found.select("clip", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in COLOURS])).alias("c")).groupBy("clip", "c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    medians = counts.groupBy("clip").agg(*[F.expr(f"percentile(if(k = '{k}', v, null), 0.5, n)").alias(k) for k in COLOURS])
    whole = d.select("clip").distinct().join(medians, "clip", "left")
    return whole.select("clip", *[_six(F.coalesce(F.col(k), F.lit(v))).alias(n) for k, v, n in zip(COLOURS, (0.0, 255.0, 0.0), ("red", "green", "blue"))])


_SCREEN = gs.query("SELECT clip, " + ", ".join(f"{gs.rnd(f'coalesce(median(CASE WHEN s THEN {k} END), {v}e0)')} AS {n}" for k, v, n in zip(COLOURS, (0, 255, 0), ("red", "green", "blue"))) + " FROM s GROUP BY clip",
                   s="SELECT *, (y = 0 OR y = 7 OR x = 0 OR x = 7) AND a <= 0.04e0 AND g > r + 12 AND g > b + 12 AS s FROM px")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.quality(frames(spark, sf_dir))
    return d.select("clip", "frames", "speckles", "holes", *[_six(F.col(k)).alias(k) for k in ("edge", "residue", "flicker", "overall_score")])


def all_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.risks(owned(spark, sf_dir))


def risk(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: all_risks(s, d).where(F.col("risk") == name).select("clip", _six(F.col("score")).alias("score"), "level")


def smoothed(mode: str, sql) -> Relation:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = api.stabilise(frames(spark, sf_dir), mode)
        return api.cells(d, "alpha").select(*api.KEYS, "y", "x", _six(F.col("alpha")).alias("alpha"))

    return query(build, sql)


_EMA = gs.query("SELECT clip, frame_idx, y, x, " + gs.rnd("s") + " AS alpha FROM r0", o="SELECT *, row_number() OVER (PARTITION BY clip, y, x ORDER BY frame_idx) AS n FROM px",
                r0="SELECT clip, frame_idx, y, x, n, a AS s FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.frame_idx, o.y, o.x, o.n, 0.85e0 * r0.s + 0.15000000000000002e0 * o.a FROM r0 JOIN o ON o.clip = r0.clip AND o.y = r0.y AND o.x = r0.x AND o.n = r0.n + 1")


def _pulled(a: str, by: str, w: float) -> str:
    weight = f"(least(1e0, greatest(0e0, 3e0 * abs({a} - {by}))) * {w}e0 * (CASE WHEN {a} < 0.02e0 OR {a} > 0.98e0 THEN 0.1e0 ELSE 1e0 END))"
    return f"least(1e0, greatest(0e0, CASE WHEN {a} > 0.03e0 AND {a} < 0.75e0 THEN 0.8e0 * {a} + 0.2e0 * {by} ELSE (1e0 - {weight}) * {a} + {weight} * {by} END))"


_ADAPTIVE = gs.query("SELECT f.clip, f.frame_idx, f.y, f.x, " + gs.rnd("(f.s + b0.s) / 2e0") + " AS alpha FROM f0 f JOIN b0 USING (clip, y, x, n)",
                     o="SELECT *, row_number() OVER (PARTITION BY clip, y, x ORDER BY frame_idx) AS n, count(*) OVER (PARTITION BY clip, y, x) AS of_ FROM px",
                     f0=f"SELECT clip, frame_idx, y, x, n, of_, a AS s FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.frame_idx, o.y, o.x, o.n, o.of_, {_pulled('o.a', 'f0.s', 0.5)} FROM f0 JOIN o ON o.clip = f0.clip AND o.y = f0.y AND o.x = f0.x AND o.n = f0.n + 1",
                     b0=f"SELECT clip, y, x, n, s FROM f0 WHERE n = of_ UNION ALL SELECT f0.clip, f0.y, f0.x, f0.n, {_pulled('f0.s', 'b0.s', 0.25)} FROM b0 JOIN f0 ON f0.clip = b0.clip AND f0.y = b0.y AND f0.x = b0.x AND f0.n = b0.n - 1")


# --- selection among candidates


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates for each frame: the base alpha, a flattened one and a steeper one."""
    made = F.array(F.struct(F.lit(0).alias("ord"), F.lit("base").alias("candidate"), F.col("a")), F.struct(F.lit(1).alias("ord"), F.lit("flat").alias("candidate"), F.transform("ai", lambda v: 0.25 + 0.5 * v).alias("a")),
                   F.struct(F.lit(2).alias("ord"), F.lit("steep").alias("candidate"), F.transform("a", lambda v: v * v).alias("a")))
    return frames(spark, sf_dir).select(*api.KEYS, "height", "width", F.explode(made).alias("c")).select(*api.KEYS, "height", "width", "c.*")


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.select(candidates(spark, sf_dir), owned(spark, sf_dir))


def standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = api.per_frame(candidates(spark, sf_dir), lambda f: rules.measured(f["a"]), api.MEASURED, "a", keep=("clip", "frame_idx", "ord", "candidate"))
    w = Window.partitionBy("clip", "frame_idx").orderBy("holes", "speckles", F.round("score", 9).desc(), F.round("edge", 9), "ord")
    return d.withColumn("k", F.row_number().over(w)).where("k = 1").select(*api.KEYS, "candidate", "holes", "speckles")


def _analysed(values: str, suffix: str) -> dict[str, str]:
    """Steps to an_<suffix>: holes, speckles, edge and score of each frame of rows (c, frame_idx, y, x, v); c tells clip and candidate."""
    t = suffix
    join = lambda a, b: f"{b}.c = {a}.c AND {b}.frame_idx = {a}.frame_idx"
    near = lambda src, element, what: f"SELECT p.c, p.frame_idx, p.y, p.x, p.v, {what} FROM {src} p JOIN {src} n ON {join('p', 'n')} AND abs(n.x - p.x) <= (CASE n.y - p.y {' '.join(f'WHEN {dy} THEN {w}' for dy, w in element)} ELSE -1 END) GROUP BY p.c, p.frame_idx, p.y, p.x, p.v"
    cc = lambda name, src, cond: {f"m_{name}": f"SELECT c, frame_idx, y, x FROM {src} WHERE {cond}", f"l_{name}": f"SELECT c, frame_idx, y, x, y * 8 + x AS l FROM m_{name} UNION SELECT m.c, m.frame_idx, m.y, m.x, k.l FROM l_{name} k JOIN m_{name} m ON {join('k', 'm')} AND abs(k.y - m.y) <= 1 AND abs(k.x - m.x) <= 1",
                                         f"s_{name}": f"SELECT c, frame_idx, y, x, count(*) OVER (PARTITION BY c, frame_idx, l) AS area FROM (SELECT c, frame_idx, y, x, min(l) AS l FROM l_{name} GROUP BY ALL)"}
    return {
        f"v_{t}": values, f"e_{t}": near(f"v_{t}", gs.CROSS, "p.v > 0.05e0 AND p.v < 0.95e0 AND bool_or(n.v >= 0.95e0) AS edge"),
        f"d_{t}": near(f"v_{t}", gs.ellipse(5), "bool_or(n.v >= 0.7e0) AS grown"), f"q_{t}": near(f"d_{t}", gs.ellipse(5), "bool_and(n.grown) AND p.v < 0.7e0 AS hole"),
        **cc(f"s{t}", f"e_{t}", "v > 0.03e0 AND v < 0.95e0 AND NOT edge"), **cc(f"h{t}", f"q_{t}", "hole"),
        f"an_{t}": f"""SELECT *, greatest(0e0, 1e0 - least(1e0, 0.35e0 * edge + 0.2e0 * residue + 0.5e0 * least(1e0, (holes + speckles) / cells))) AS score FROM (
            SELECT c, frame_idx, avg(CASE WHEN edge THEN 1e0 ELSE 0e0 END) AS edge, count(*)::DOUBLE AS cells, sum(CASE WHEN v < 0.05e0 THEN v ELSE 0e0 END) / count(*) AS residue, coalesce(any_value(h.n), 0) AS holes, coalesce(any_value(s.n), 0) AS speckles
            FROM e_{t} e LEFT JOIN (SELECT c, frame_idx, count(*) AS n FROM s_h{t} WHERE area >= 5 GROUP BY ALL) h USING (c, frame_idx) LEFT JOIN (SELECT c, frame_idx, count(*) AS n FROM s_s{t} WHERE area <= 12 GROUP BY ALL) s USING (c, frame_idx) GROUP BY c, frame_idx)"""}


_CANDS = f"SELECT clip * 10 + ord AS c, frame_idx, y, x, ca AS v FROM ({CANDIDATES.sql()})"
_ALONE = ("SELECT clip, frame_idx, candidate, holes, speckles FROM (SELECT (c // 10)::INT AS clip, frame_idx, CASE c % 10 WHEN 0 THEN 'base' WHEN 1 THEN 'flat' ELSE 'steep' END AS candidate, holes, speckles, row_number() OVER "
          "(PARTITION BY c // 10, frame_idx ORDER BY holes, speckles, round(score, 9) DESC, round(edge, 9), c) AS k FROM an_c) WHERE k = 1")
_RANKED = AGGREGATES["ranked"].sql()
_SELECT_STEPS = {
    **_analysed(_CANDS, "c"), "rk": f"SELECT * FROM ({_RANKED})", "mk": gs.MASKED,
    # Champions: non-edge regions by the best rank, edge regions by the fold over the three candidates in order.
    "rw": "SELECT clip, frame_idx, region, max(CASE WHEN ord = 0 THEN rank END) AS r0, max(CASE WHEN ord = 1 THEN rank END) AS r1, max(CASE WHEN ord = 2 THEN rank END) AS r2, max(CASE WHEN ord = 0 THEN own END) AS o0, max(CASE WHEN ord = 1 THEN own END) AS o1, max(CASE WHEN ord = 2 THEN own END) AS o2, "
    "max(CASE WHEN ord = 0 THEN overall END) AS a0, max(CASE WHEN ord = 1 THEN overall END) AS a1, max(CASE WHEN ord = 2 THEN overall END) AS a2 FROM rk GROUP BY ALL",
    "c1": "SELECT *, CASE WHEN r1 > r0 AND (region NOT IN ('hair', 'uncertain') OR (o1 >= o0 + 0.03e0 AND a1 >= a0 - 0.05e0)) THEN 1 ELSE 0 END AS w1 FROM rw",
    "c2": "SELECT *, CASE w1 WHEN 0 THEN r0 ELSE r1 END AS rb, CASE w1 WHEN 0 THEN o0 ELSE o1 END AS ob, CASE w1 WHEN 0 THEN a0 ELSE a1 END AS ab FROM c1",
    "ch": "SELECT clip, frame_idx, region, CASE WHEN r2 > rb AND (region NOT IN ('hair', 'uncertain') OR (o2 >= ob + 0.03e0 AND a2 >= ab - 0.05e0)) THEN 2 ELSE w1 END AS win FROM c2",
    "ow": f"SELECT {gs.KEYS}, CASE WHEN subject THEN 'subject' WHEN hair THEN 'hair' WHEN luminous THEN 'luminous' WHEN transparent THEN 'transparent' WHEN residue THEN 'residue' WHEN uncertain THEN 'uncertain' ELSE 'none' END AS region FROM mk",
    "pk": "SELECT ow.*, coalesce(win, 0) AS win FROM ow LEFT JOIN ch USING (clip, frame_idx, region)",
    "se": "SELECT pk.*, k.v FROM pk JOIN v_c k ON k.c = pk.clip * 10 + pk.win AND k.frame_idx = pk.frame_idx AND k.y = pk.y AND k.x = pk.x",
    **_analysed("SELECT clip AS c, frame_idx, y, x, v FROM se", "s"),
    "al": f"SELECT c // 10 AS clip, c % 10 AS ord, frame_idx, holes, speckles, edge, score, row_number() OVER (PARTITION BY c // 10, frame_idx ORDER BY holes, speckles, score DESC, edge, c) AS k FROM an_c",
    "tk": "SELECT s.clip, s.frame_idx, s.win AS subject, bool_or(e.win <> s.win) AS takes FROM (SELECT DISTINCT clip, frame_idx, win FROM pk WHERE region = 'subject') s JOIN (SELECT DISTINCT clip, frame_idx, win FROM pk WHERE region IN ('hair', 'uncertain')) e USING (clip, frame_idx) GROUP BY ALL",
    "gd": "SELECT an_s.c AS clip, an_s.frame_idx, an_s.holes AS h, an_s.score AS sc, an_s.edge AS ed, al.ord AS alone, al.holes AS h0, al.score AS sc0, al.edge AS ed0, coalesce(takes, false) AS takes, subject, b.holes AS h1, b.score AS sc1, b.edge AS ed1 FROM an_s JOIN al ON al.clip = an_s.c AND al.frame_idx = an_s.frame_idx AND al.k = 1 "
    "LEFT JOIN tk ON tk.clip = an_s.c AND tk.frame_idx = an_s.frame_idx LEFT JOIN al b ON b.clip = an_s.c AND b.frame_idx = an_s.frame_idx AND b.ord = tk.subject",
    "rs": "SELECT *, h > h0 + 5 AS x1, sc0 - sc > 0.0003e0 AS x2, ed - ed0 > 0.001e0 AS x3, takes AND h > h1 + 5 AS z1, takes AND sc1 - sc > 0.0003e0 AS z2, takes AND ed - ed1 > 0.001e0 AS z3 FROM gd",
    "fin": "SELECT *, concat_ws(',', CASE WHEN x1 THEN 'hole_pixels' END, CASE WHEN x2 THEN 'overall_score' END, CASE WHEN x3 THEN 'mean_edge_uncertainty' END, CASE WHEN takes THEN 'edge_takeover' END, CASE WHEN z1 AND NOT x1 THEN 'hole_pixels' END, CASE WHEN z2 AND NOT x2 THEN 'overall_score' END, CASE WHEN z3 AND NOT x3 THEN 'mean_edge_uncertainty' END) AS reasons, CASE WHEN takes THEN subject ELSE alone END AS safe FROM rs"}
_NAMED = "CASE {} WHEN 0 THEN 'base' WHEN 1 THEN 'flat' ELSE 'steep' END"


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).select(*api.KEYS, F.col("selected_holes").alias("holes"), F.array_join("reasons", ",").alias("reasons"), "fallback", (F.size("reasons") > 0).alias("rolled_back"), _six(F.col("selected_score")).alias("score"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.cells(selection(spark, sf_dir), "alpha").select(*api.KEYS, "y", "x", _six(F.col("alpha")).alias("alpha"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection(spark, sf_dir).select(*api.KEYS, F.explode("decisions").alias("d"))
    names = F.create_map(*[F.lit(x) for pair in VIEWED.items() for x in pair])
    return d.select(*api.KEYS, names[F.col("d.region")].alias("region"), "d.candidate", F.col("d.pixels").alias("pixels"))


_DECIDED = gs.query(f"SELECT clip, frame_idx, region, {_NAMED.format('k')} AS candidate, pixels FROM (SELECT clip, frame_idx, region, CASE WHEN reasons <> '' THEN safe ELSE win END AS k, count(*) AS pixels FROM pk JOIN fin USING (clip, frame_idx) WHERE region <> 'none' GROUP BY ALL)", **_SELECT_STEPS)


def fusion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fused alpha (the model's, where the subject mask ends) against the base alpha."""
    def rule(f: Frame) -> dict:
        subject = f["a"] >= 0.9
        out, reasons, a, b = rules.fusion_guarded(np.where(subject, f["a"], f["ai"]), f["a"], subject, ~subject & (f["ai"] > 0.5), ~subject & (f["ai"] <= 0.5))
        return {"alpha": out, "reasons": ",".join(reasons), "holes": a["holes"], "base_holes": b["holes"]}

    d = api.per_frame(frames(spark, sf_dir), rule, "alpha array<double>, reasons string, holes long, base_holes long", "a", "ai")
    mean = F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v) / F.size("alpha")
    return d.select(*api.KEYS, "reasons", "holes", "base_holes", _six(mean).alias("mean_alpha"))


_FUSED = gs.query(
    f"SELECT f.clip, f.frame_idx, reasons, holes, base_holes, {gs.rnd('avg(CASE WHEN reasons <> {q} THEN p.a ELSE p.v END)'.replace('{q}', chr(39) * 2))} AS mean_alpha FROM fin f JOIN fu p USING (clip, frame_idx) GROUP BY ALL",
    fu="SELECT *, CASE WHEN a >= 0.9e0 THEN a ELSE ai END AS v FROM px", **_analysed("SELECT clip AS c, frame_idx, y, x, v FROM fu", "f"), **_analysed("SELECT clip AS c, frame_idx, y, x, a AS v FROM px", "b"),
    tk="SELECT clip, frame_idx, count(CASE WHEN a >= 0.7e0 AND v < a - 0.5e0 AND a < 0.9e0 THEN 1 END) > 5 AS takes FROM fu GROUP BY ALL",
    fin="SELECT tk.clip, tk.frame_idx, f.holes, b.holes AS base_holes, concat_ws(',', CASE WHEN f.holes > b.holes + 5 THEN 'hole_pixels' END, CASE WHEN b.score - f.score > 0.0003e0 THEN 'overall_score' END, CASE WHEN f.edge - b.edge > 0.001e0 THEN 'mean_edge_uncertainty' END, CASE WHEN takes THEN 'edge_takeover' END) AS reasons "
    "FROM tk JOIN an_f f ON f.c = tk.clip AND f.frame_idx = tk.frame_idx JOIN an_b b ON b.c = tk.clip AND b.frame_idx = tk.frame_idx")


def overlay(f: Frame) -> dict:
    edge, speckle, hole = rules.edge_mask(f["a"]), rules.speckle_mask(f["a"]), rules.hole_mask(f["a"])
    return {"paint": np.where(hole, 3, np.where(speckle, 2, np.where(edge, 1, 0)))}


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.cells(api.per_frame(frames(spark, sf_dir), overlay, "paint array<int>", "a"), "paint")
    return d.select(*api.KEYS, "y", "x", F.element_at(F.array(*[F.lit(x) for x in ("none", "edge", "speckle", "hole")]), F.col("paint") + 1).alias("paint"))


def bincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rule(f: Frame) -> dict:
        labels, areas = grid.components(f["a"] >= 0.7)
        seen, at = np.unique(labels.ravel(), return_index=True)
        first = dict(zip(seen.tolist(), at.tolist()))
        sums = np.bincount(labels.ravel(), weights=f["a"].ravel(), minlength=len(areas))
        return {"of": [{"label": first[k], "n": int(areas[k]), "total": float(sums[k])} for k in range(1, len(areas))]}

    d = api.per_frame(frames(spark, sf_dir), rule, "of array<struct<label:int,n:bigint,total:double>>", "a").select(*api.KEYS, F.explode("of").alias("x"))
    return d.select(*api.KEYS, "x.label", "x.n", _six(F.col("x.total")).alias("total"))


def touched(f: Frame) -> dict:
    """Cells of solid components that hold a full cell."""
    labels, areas = grid.components(f["a"] >= 0.7)
    first = np.zeros(len(areas), int)
    seen, at = np.unique(labels.ravel(), return_index=True)
    first[seen] = at
    ok = np.bincount(labels.ravel(), weights=(f["a"] >= 0.999).ravel(), minlength=len(areas)) > 0
    ok[0] = False
    return {"label": first[labels], "keep_": ok[labels]}


def within(f: Frame) -> dict:
    """Distance to the nearest full cell, up to 4."""
    d = grid.distance(f["a"] >= 0.999, 4)
    return {"distance": np.where(np.isfinite(d), d, 0.0), "keep_": np.isfinite(d) & (f["a"] < 0.999)}


def gate_masks(f: Frame) -> dict:
    """Masks of the fusion gate: what no layer owns and is soft, and solid warm props. Here a layer owns a cell that its alpha makes sure."""
    a, owned_ = f["a"], (f["a"] >= 0.9) | (f["ai"] >= 0.9) | (f["a"] <= 0.01)
    return {"hair_edge": (a > 0.05) & (a < 0.95) & ~owned_, "luminous_prop": grid.kept((a >= 0.6) & _p(f).warm & ~_p(f).screen, 3), "uncertain_edge": (a > 0.02) & (a < 0.98) & ~owned_}


_GATE_MASKS = gs.query(f"SELECT {gs.KEYS}, a > 0.05e0 AND a < 0.95e0 AND NOT owned AS hair_edge, w.alpha IS NOT NULL AS luminous_prop, a > 0.02e0 AND a < 0.98e0 AND NOT owned AS uncertain_edge FROM (SELECT *, a >= 0.9e0 OR ai >= 0.9e0 OR a <= 0.01e0 AS owned FROM px) LEFT JOIN wf w USING ({gs.KEYS})", wf=FORMS["f23"].sql())


OPS: dict[str, Relation] = {
    "f28_gate_region_masks": pixels(gate_masks, BOTH, _GATE_MASKS, None, hair_edge="boolean", luminous_prop="boolean", uncertain_edge="boolean"),
    "n01_uncertain_edge": _where(lambda f: rules.edge_mask(f["a"]), A, FORMS["n01"]),
    "n02_speckle": _components(lambda f: (f["a"] > 0.03) & (f["a"] < 0.95) & ~rules.edge_mask(f["a"]), A, "n02", 1, 12),
    "n03_hole": _components(lambda f: grid.closed(f["a"] >= 0.7, grid.ellipse(5)) & (f["a"] < 0.7), A, "n03", 5),
    "n04_small_components": _components(lambda f: f["a"] >= 0.7, A, "n04", 1, 6),
    "n05_large_components": _components(lambda f: f["a"] >= 0.7, A, "n05", 7),
    "n07_shrink_grow": pixels(lambda f: {"grown": rules.shrink_grow(f["a"], 1), "shrunk": rules.shrink_grow(f["a"], -2)}, A, gs.query(gs.shown(f"(SELECT * FROM g JOIN s USING ({gs.KEYS}))", grown="hi / 255e0", shrunk="lo / 255e0"), u=_U, g=gs.near("u", gs.CROSS, hi="max(n.u8)"), s=gs.near("u", gs.ellipse(5), lo="min(n.u8)")), None, grown="double", shrunk="double"),
    "n08_edge_blur": pixels(lambda f: {"alpha": rules.edge_blur(f["a"], 1), "wide": rules.edge_blur(f["a"], 2)}, A, gs.query(gs.shown(f"(SELECT *, floor(s3 + 0.5e0) / 255e0 AS v, floor(s5 + 0.5e0) / 255e0 AS w FROM b3 JOIN b5 USING ({gs.KEYS}))", alpha="v", wide="w"), u=_U, b3=gs.filtered("u", gs.gauss(3), "u8", "s3"), b5=gs.filtered("u", gs.gauss(5), "u8", "s5")), None, alpha="double", wide="double"),
    "n09_guided_smooth": _alpha(lambda f: rules.smoothed(f["a"], (f["a"] > 0.05) & (f["a"] < 0.95)), A, gs.query(gs.shown(f"(SELECT *, (CASE WHEN {_SOFT} THEN blur ELSE a END) AS v FROM px JOIN bl USING ({gs.KEYS}))", alpha="v"), **_blurred(9))),
    "n10_median_despeckle": _alpha(lambda f: grid.median(rules.bytes_of(f["a"]), 5) / 255, A, gs.query(gs.shown("m1", alpha="med / 255e0"), **gs.despeckle(5))),
    "n11_soft_support_restore": _alpha(lambda f: rules.despeckled(f["a"], 2), A, gs.query(gs.shown("dk", alpha="alpha"), **gs.despeckle(5))),
    "n12_luminous_restore": _alpha(lambda f: rules.despeckled(f["a"], 2, 0.0, _p(f), regions_of(f)), ALL, gs.query(gs.shown("dk", alpha="alpha"), **gs.despeckle(5, True))),
    "n18_despeckle_sequence": pixels(lambda f: {"cleaned": rules.despeckled(f["a"], 2, 0.0, _p(f), regions_of(f)), "original": f["a"]}, ALL, gs.query(gs.shown(f"(SELECT dk.*, a FROM dk JOIN px USING ({gs.KEYS}))", cleaned="alpha", original="a"), **gs.despeckle(5, True)), None, cleaned="double", original="double"),
    "n13_subject_edge_repair": _alpha(lambda f: rules.subject_edge_repair(f["a"]), A, FORMS["n13"]),
    "n14_border_screen_pixels": pixels(ladder, ALL, _LADDER, "keep_", red="double", green="double", blue="double"),
    "f05_region_residue": _components(lambda f: regions_of(f)["background_residue"], ALL, "f05", 3),
    "f13_particle_mask": _mask(lambda f: rules.black_masks(_p(f))["particle"], COLOURS, gs.query(f"SELECT {gs.KEYS}, particle FROM bk", **gs.black()), "particle"),
    "f14_subject_edge_mask": _mask(lambda f: rules.subject_edge(f["a"]), A, FORMS["f14"], "edge"),
    "f23_warm_prop_layer": pixels(lambda f: {"alpha": np.maximum(f["a"], 0.98), "keep_": grid.kept((f["a"] >= 0.6) & _p(f).warm & ~_p(f).screen, 3)}, ALL, FORMS["f23"], "keep_", alpha="double"),
    "f24_cyan_halo_band": _alpha(lambda f: rules.cyan_halo(_p(f).glare, _p(f), f["a"]), ALL, gs.query(gs.shown(
        f"(SELECT *, (CASE WHEN reach AND NOT core AND b > 140 AND g > 120 AND r < 150 AND br > 120 AND a < 0.45e0 AND NOT {gs.SCREEN} THEN (0.36e0 + 0.18e0 * greatest(0e0, (14e0 - dist) / 14e0)) * ({_RAMP} * {_RAMP} * (3e0 - 2e0 * {_RAMP})) ELSE 0e0 END) AS v FROM h0 JOIN h1 USING ({gs.KEYS}))", weight="v"), **_HALO), "weight"),
    "f29_trimap": pixels(lambda f: {"trimap": rules.trimap(f["a"])}, A, gs.query(f"SELECT {gs.KEYS}, trimap FROM tri", **_TRI), None, trimap="int"),
    "p06_chroma_key": _alpha(lambda f: rules.chroma_key(_p(f)), COLOURS, _KEYED),
    "u05_traditional_candidate": _alpha(lambda f: rules.green_alpha(_p(f)), COLOURS, _KEYED),
    "p10_clip_black_white": pixels(lambda f: {"alpha": rules.clip_levels(f["a"], 0.1, 0.9), "hard": rules.clip_levels(f["a"], 0.4, 0.3), "untouched": rules.clip_levels(f["a"], 0.0, 1.0)}, A,
                                   gs.query(gs.shown("px", alpha="least(1e0, greatest(0e0, (a - 0.1e0) / 0.8e0))", hard="least(1e0, greatest(0e0, (a - 0.4e0) / (0.401e0 - 0.4e0)))", untouched="a")), None, alpha="double", hard="double", untouched="double"),
    "p11_black_key": _alpha(lambda f: rules.black_enhanced(_p(f), rules.black_base(_p(f)))[0], COLOURS, gs.query(gs.shown("bk", alpha="alpha"), **_BASE11, **_BLACK11, **_on(gs.black("kb"), "kp"))),
    "p19_warm_solid_spill": _colours(lambda f: rules.beside_warm(rules.despilled(_p(f), f["a"]), _p(f), f["a"]), gs.query(
        gs.shown(f"(SELECT *, (CASE WHEN near AND ds.a > 0.2e0 AND ds.g > ds.r + 12 AND ds.g > ds.b + 6 AND ds.r < 170 AND ds.g > 95 THEN greatest(0e0, ds.g - greatest(ds.r, ds.b)) ELSE 0e0 END) AS gap FROM ds JOIN w1 USING ({gs.KEYS}))", red="rc + gap * 0.7e0", green="gc - gap * 0.45e0", blue="bc + gap * 0.18e0"),
        **_WARM, w1=gs.near("w0", gs.ellipse(17), near="bool_or(n.warm)"), **_DESPILLED)),
    "p23_ring_neighbor_cleanup": _colours(lambda f: rules.beside_ring(rules.despilled(_p(f), f["a"]), f["a"]), gs.query(
        gs.shown(f"(SELECT d1.*, (CASE WHEN around AND NOT bright AND a > 0.05e0 AND a < 0.88e0 AND cch < 110 AND gc > rc + 10 AND bc > rc + 10 THEN greatest(0e0, least(gc - rc, bc - rc)) ELSE 0e0 END) AS gap FROM d1 JOIN r1 USING ({gs.KEYS}))", red="rc + gap * 0.55e0", green="gc - gap * 0.2e0"),
        **_DESPILLED, d0="SELECT *, (rc + gc + bc) / 3e0 AS cbr, greatest(rc, gc, bc) - least(rc, gc, bc) AS cch FROM ds", d1="SELECT *, a > 0.92e0 AND cbr > 210 AND cch < 55 AS bright FROM d0", r1=gs.near("d1", gs.ellipse(11), around="bool_or(n.bright)")), 2),
    "p25_prop_projection": _colours(lambda f: rules.onto_props(rules.despilled(_p(f), f["a"]), f["a"], rules.warm_reach(_p(f), f["a"]) | regions_of(f)["luminous_prop"]), gs.query(
        gs.shown(f"(SELECT ds.*, (CASE WHEN (reach OR luminous) AND a > 0.08e0 AND gc > rc + 6 AND gc > bc + 3 THEN greatest(0e0, gc - greatest(rc, bc)) ELSE 0e0 END) AS gap FROM ds JOIN w1 USING ({gs.KEYS}) JOIN mk USING ({gs.KEYS}))", red="rc + gap * 0.45e0", green="gc - gap * 0.85e0", blue="bc + gap * 0.1e0"),
        **_WARM, w1=gs.near("w0", gs.ellipse(19), reach="bool_or(n.seed)"), **_DESPILLED, mk=gs.MASKED)),
    "p26_warm_prop_reach": _mask(lambda f: rules.warm_reach(_p(f), f["a"]), ALL, gs.query(f"SELECT {gs.KEYS}, reach FROM w1", **_WARM, w1=gs.near("w0", gs.ellipse(19), reach="bool_or(n.seed)")), "reach"),
    "p41_rvm_enhance_alpha": _alpha(lambda f: rules.enhanced_alpha(f["a"]), A, gs.query(gs.shown("(SELECT *, (CASE WHEN l > 0.85e0 THEN 0.85e0 + (l - 0.85e0) * 1.1e0 ELSE l END) AS v FROM (SELECT *, (CASE WHEN pow(a, 0.8e0) < 0.1e0 THEN pow(a, 0.8e0) * 1.2e0 ELSE pow(a, 0.8e0) END) AS l FROM px))", alpha="least(1e0, greatest(0e0, v))"))),
    "p43_prop_restore": pixels(lambda f: {"alpha": rules.prop_restored(f["ai"], f["a"], regions_of(f)), "other_model": rules.prop_restored(f["ai"], f["a"], regions_of(f), "green", "rvm")}, BOTH, gs.query(
        gs.shown(f"(SELECT ai, (CASE WHEN luminous THEN greatest(ai, greatest(a, 0.985e0)) ELSE ai END) AS v, {gs.KEYS} FROM px JOIN mk USING ({gs.KEYS}))", alpha="v", other_model="ai"), mk=gs.MASKED), None, alpha="double", other_model="double"),
    "p44_swirl_preserve": _alpha(lambda f: rules.swirl_kept(_p(f), f["a"]), ALL, _swirl_sql()),
    "p49_corridor_post_order": _alpha(lambda f: rules.corridor_post(f["a"], 0.1, 0.9, 1, 1), A, gs.query(gs.shown("g2", alpha="least(1e0, greatest(0e0, (gb / 255e0 - 0.1e0) / 0.8e0))"), u=_U, **gs.grown_blurred("u"))),
    "p50_green_generate": _alpha(lambda f: rules.green_alpha(_p(f), 1, 1), COLOURS, gs.query(gs.shown("g2", alpha="gb / 255e0"), **_KEY, **gs.grown_blurred("kc"))),
    "u13_black_path": _alpha(lambda f: rules.black_merged(_p(f), f["a"], f["ai"]), BOTH, gs.query(
        gs.shown(f"(SELECT {gs.KEYS}, sol + greatest(0.35e0 * t * t * (3e0 - 2e0 * t), effect) * (1e0 - sol) AS v FROM (SELECT bk.*, greatest(px.ai, CASE WHEN px.a > 0.75e0 THEN px.a ELSE 0e0 END) AS sol, least(1e0, greatest(0e0, (px.a - 0.03e0) / 0.42e0)) AS t FROM bk JOIN px USING ({gs.KEYS})))", alpha="v"), **gs.black())),
    "u15_black_enhance": _alpha(lambda f: rules.black_enhanced(_p(f), f["a"])[0], ALL, gs.query(gs.shown("bk", alpha="alpha"), **gs.black())),
    "u16_refine": _alpha(lambda f: rules.refined(f["a"], regions_of(f))[0], ALL, gs.query(gs.shown("rf", alpha="alpha"), **_REFINED)),
    "k15_overlay_edge_speckle_hole": query(painted, FORMS["k15"]),
    "a38_component_bincount": query(bincount, FORMS["a38"]),
    "j07_label_semijoin": pixels(touched, A, FORMS["j07"], "keep_", label="int"),
    "j08_distance_range_join": pixels(within, A, gs.query(gs.shown("d WHERE d <= 4", distance="d"), c="SELECT *, a >= 0.999e0 AS core FROM px", d=f"SELECT * FROM (SELECT p.clip, p.frame_idx, p.y, p.x, min(sqrt((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x))) AS d FROM c p JOIN c n ON n.clip = p.clip AND n.frame_idx = p.frame_idx AND n.core WHERE NOT p.core GROUP BY ALL)"), "keep_", distance="double"),
    "a01_alpha_quality": query(quality, AGGREGATES["a01"]),
    "a11_risk_hair": query(risk("hair_edge_loss"), AGGREGATES["a11"]), "a12_risk_residue": query(risk("background_residue"), AGGREGATES["a12"]), "a13_risk_light": query(risk("light_subject_loss"), AGGREGATES["a13"]),
    "a14_risk_transparent": query(risk("transparent_effect_loss"), AGGREGATES["a14"]), "a15_risk_temporal": query(risk("temporal_instability"), AGGREGATES["a15"]), "a16_risk_subject": query(risk("subject_misidentification"), AGGREGATES["a16"]),
    "a17_risk_level": query(lambda s, d: api.quality(frames(s, d)).select("clip", api.level_of((1 - F.col("overall_score")) * 4).alias("level")), AGGREGATES["a17"]),
    "a18_p0_report": query(lambda s, d: all_risks(s, d).select("clip", "ord", "risk", _six(F.col("score")).alias("score"), "level"), AGGREGATES["a18"]),
    "x35_risk_signal_rounding": query(lambda s, d: all_risks(s, d).where("ord = 0").select("clip", F.explode("signals").alias("signal", "value")), AGGREGATES["x35"]),
    "a24_black_effect_history": query(black_history, _BLACK_HISTORY),
    "a25_edge_reconstruction": query(reconstruction, _RECONSTRUCTION),
    "a27_screen_color_median": query(screen_colour, _SCREEN),
    "w01_temporal_flicker": query(lambda s, d: api.flicker(frames(s, d)).select("clip", _six(F.col("flicker")).alias("flicker")), AGGREGATES["w01"]),
    "w02_ema": smoothed("fast", _EMA),
    "w03_adaptive_bidirectional": smoothed("standard", _ADAPTIVE),
    "r02_standalone_best": query(standalone, gs.query(_ALONE, **_analysed(_CANDS, "c"))),
    "r03_region_select": query(chosen, gs.query(gs.shown("(SELECT se.clip, se.frame_idx, se.y, se.x, CASE WHEN reasons <> '' THEN k.v ELSE se.v END AS v FROM se JOIN fin USING (clip, frame_idx) JOIN v_c k ON k.c = se.clip * 10 + fin.safe AND k.frame_idx = se.frame_idx AND k.y = se.y AND k.x = se.x)", alpha="v"), **_SELECT_STEPS)),
    "r04_selection_guard": query(guard, gs.query(f"SELECT clip, frame_idx, h AS holes, reasons, CASE WHEN reasons <> '' THEN {_NAMED.format('safe')} END AS fallback, reasons <> '' AS rolled_back, {gs.rnd('sc')} AS score FROM fin", **_SELECT_STEPS)),
    "r07_fusion_risk_guard": query(fusion_guard, _FUSED),
    "r20_selection_payload": query(decisions, _DECIDED),
    "a23_selected_model_counts": query(lambda s, d: decisions(s, d).groupBy("candidate").agg(F.count(F.lit(1)).alias("decisions")), f"SELECT candidate, count(*) AS decisions FROM ({_DECIDED}) GROUP BY ALL"),
}

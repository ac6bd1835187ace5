"""Queries of topology, layers, models, the whole pipeline, images, jobs and text outputs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.frames import api, grid, models, process, rules
from alphaloom.frames.api import KEYS, Frame
from alphaloom.functions import pixel as px
from alphaloom.operators.aggregates import FORMS as AGGREGATES
from alphaloom.operators.framed import A, ALL, BOTH, COLOURS, OPS as FRAMED, VIEWED, _six, candidates, frames, owned, pixels, query
from alphaloom.operators.gates import items, reports, run
from alphaloom.operators.points import AI_SOLID, EFFECT_LAYER, GATE, LAYERS, OPS as POINTS, SOLID
from alphaloom.plans import grid_sql as gs
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import JOBS, MASKS, PIXELS
from alphaloom.reports import regression
from alphaloom.settings import Settings
from alphaloom.sources import images, png

#: Side to which the view's small frames are enlarged for rules whose reach is wider than they are.
WIDE = 64


class Enlarged:
    """A frame's pictures and alphas, enlarged if it is as small as the view's."""

    def __init__(self, f: Frame):
        size = (WIDE, WIDE) if f.shape == (8, 8) else f.shape
        self.of = lambda name: rules.resized(f[name], *size)
        self.p = rules.Picture(*[np.floor(self.of(c)) for c in COLOURS])


def counted(rule, *names: str) -> Relation:
    """Cells and sum of layers of each frame."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        def each(f: Frame) -> dict:
            out = {}
            for n, layer in zip(names, rule(Enlarged(f))):
                out |= {f"{n}_cells": int((layer > 0).sum()), f"{n}_sum": float(np.sum(layer, dtype=float))}
            return out

        d = api.per_frame(frames(spark, sf_dir), each, ", ".join(f"{n}_cells long, {n}_sum double" for n in names), *BOTH)
        return d.select(*KEYS, *[F.col(f"{n}_cells") for n in names], *[_six(F.col(f"{n}_sum")).alias(f"{n}_sum") for n in names])

    return query(build, None)


def gate_of(e: Enlarged) -> np.ndarray:
    return rules.smoothstep(rules.subject_confidence(e.p, e.of("ai"), e.of("a")), 0.45, 0.80)


def _integrity(e: Enlarged):
    return [rules.subject_integrity(e.p, e.of("ai"), e.of("a"), gate_of(e))]


def _holes(f: Frame) -> dict:
    mask = f["a"] >= 0.7
    return {"whole": grid.fill_holes(mask, np.ones_like(mask), 4.0), "allowed": grid.fill_holes(mask, f["ai"] >= 0.3, 4.0)}


def _filled_sql(name: str, source: str, mask: str, allowed: str, least: float) -> dict[str, str]:
    """Steps to <name>(.., filled): a mask with what it encloses, where allowed. Outside is what four-connected steps reach from a rim around the frame; an outline's area counts the squares between cells of one component."""
    n = name
    return {
        f"{n}_f": f"SELECT f.clip, f.frame_idx, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT clip, frame_idx FROM px) f CROSS JOIN range(-1, 9) b(y) CROSS JOIN range(-1, 9) c(x) ANTI JOIN (SELECT {gs.KEYS} FROM {source} WHERE {mask}) m USING ({gs.KEYS})",
        f"{n}_o": f"SELECT {gs.KEYS} FROM {n}_f WHERE y = -1 AND x = -1 UNION SELECT f.clip, f.frame_idx, f.y, f.x FROM {n}_o o JOIN {n}_f f ON f.clip = o.clip AND f.frame_idx = o.frame_idx AND abs(f.y - o.y) + abs(f.x - o.x) = 1",
        f"{n}_s": f"SELECT {gs.KEYS} FROM px ANTI JOIN {n}_o USING ({gs.KEYS})",
        f"{n}_l": f"SELECT {gs.KEYS}, y * 8 + x AS l FROM {n}_s UNION SELECT m.clip, m.frame_idx, m.y, m.x, k.l FROM {n}_l k JOIN {n}_s m ON m.clip = k.clip AND m.frame_idx = k.frame_idx AND abs(m.y - k.y) <= 1 AND abs(m.x - k.x) <= 1",
        f"{n}_c": f"SELECT {gs.KEYS}, min(l) AS l FROM {n}_l GROUP BY {gs.KEYS}",
        f"{n}_q": f"SELECT clip, frame_idx, l, y - dy AS qy, x - dx AS qx, count(*) AS n FROM {n}_c CROSS JOIN range(2) a(dy) CROSS JOIN range(2) b(dx) GROUP BY ALL",
        f"{n}_b": f"SELECT clip, frame_idx, l FROM {n}_q GROUP BY clip, frame_idx, l HAVING sum(CASE n WHEN 4 THEN 1e0 WHEN 3 THEN 0.5e0 ELSE 0e0 END) >= {least}",
        name: f"SELECT s.*, ({mask}) OR (k.l IS NOT NULL AND ({allowed})) AS filled FROM {source} s LEFT JOIN (SELECT c.* FROM {n}_c c JOIN {n}_b USING (clip, frame_idx, l)) k USING ({gs.KEYS})"}


_HOLES = gs.query("SELECT px.clip, px.frame_idx, px.y, px.x, h1.filled AS whole, h2.filled AS allowed FROM px JOIN h1 USING (clip, frame_idx, y, x) JOIN h2 USING (clip, frame_idx, y, x)",
                  **_filled_sql("h1", "px", "a >= 0.7e0", "true", 4), **_filled_sql("h2", "px", "a >= 0.7e0", "ai >= 0.3e0", 4))


def _luminous_sql() -> str:
    """Shells filled, their reach, closed candidates filled again, and components of eight cells with a warm one."""
    keep, steps = gs.KEYS, {}
    steps["p0"] = (f"SELECT *, {gs.WARM} AND NOT {gs.SCREEN} AS shell, br > 165 AND r > 190 AND g > 145 AND b > 70 AND NOT {gs.SCREEN} AS bright, br > 185 AND r > 175 AND g > 150 AND b > 95 AND ch < 120 AND NOT {gs.SCREEN} AS pale, "
                   f"r > 145 AND g > 105 AND b < 190 AND r - b > 20 AND NOT {gs.SCREEN} AS halo FROM px")
    steps |= _filled_sql("p1", "p0", "shell", "a >= 0.55e0", 12)
    # On 8 x 8 cells any shell is within 45 of every cell.
    steps["p2"] = gs.near("p1", gs.ellipse(19), near="bool_or(n.filled)")
    steps["p3"] = f"SELECT p1.* EXCLUDE (filled), filled, bool_or(filled) OVER (PARTITION BY clip, frame_idx) AS any_, near FROM p1 JOIN p2 USING ({keep})"
    steps["p4"] = "SELECT * EXCLUDE (filled, near), filled, near OR ((bright OR pale) AND any_) AS reach, a >= 0.18e0 OR bright OR pale OR halo AS support FROM p3"
    steps["p5"] = "SELECT * EXCLUDE (filled), reach AND support AND (filled OR shell OR bright OR pale OR halo) AS cand FROM p4"
    steps["p6"] = gs.near("p5", gs.ellipse(11), grown="bool_or(n.cand)")
    steps["p7"] = gs.near("p6", gs.ellipse(11), cl="bool_and(n.grown)")
    steps["p8"] = f"SELECT p5.*, cl FROM p5 JOIN p7 USING ({keep})"
    steps |= _filled_sql("p9", "p8", "cl", "reach AND support", 12)
    steps["pl"] = f"SELECT {keep}, y * 8 + x AS l FROM p9 WHERE filled AND any_ UNION SELECT m.clip, m.frame_idx, m.y, m.x, k.l FROM pl k JOIN p9 m ON m.filled AND m.clip = k.clip AND m.frame_idx = k.frame_idx AND abs(m.y - k.y) <= 1 AND abs(m.x - k.x) <= 1"
    steps["pc"] = f"SELECT {keep}, min(l) AS l FROM pl GROUP BY {keep}"
    steps["pk"] = f"SELECT clip, frame_idx, l FROM pc JOIN p0 USING ({keep}) GROUP BY clip, frame_idx, l HAVING count(*) >= 8 AND bool_or(shell)"
    return gs.query(f"SELECT {keep}, k.l IS NOT NULL AS luminous FROM px LEFT JOIN (SELECT pc.* FROM pc JOIN pk USING (clip, frame_idx, l)) k USING ({keep})", **steps)


# --- models


def fakes() -> list[models.Generator]:
    """Generators as tests use them: keys, stand-ins for models with and without state, one without guidance, one that isn't there, one that fails."""
    def steady():
        def rule(f: Frame, state):
            a = f["a"] if state is None else 0.5 * state + 0.5 * f["a"]
            return a, a

        return rule

    def broken():
        def rule(f: Frame):
            raise RuntimeError("no weights")

        return rule

    return [models.traditional(), models.Generator("birefnet", lambda: lambda f: {"matte": f["ai"] * 255}, ("ai",)), models.Generator("rvm", steady, ("a",), recurrent=True),
            models.Generator("sam2", lambda: lambda f: f["a"], ("a",), guidance="mask"), models.Generator("gvm", None), models.Generator("matanyone2", broken, ("a",)), models.Generator("rembg", steady, ("a",), enabled=False)]


def generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return models.generate(frames(spark, sf_dir), fakes())


def driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that worked, and which of them each clip's regions took."""
    made, _ = generated(spark, sf_dir)
    d = api.select(made, owned(spark, sf_dir)).select("clip", F.explode("decisions").alias("d"))
    return d.groupBy("clip", F.col("d.candidate").alias("candidate")).agg(F.count(F.lit(1)).alias("decisions"), F.sum("d.pixels").alias("pixels"))


def model_alphas(name: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made, _ = generated(spark, sf_dir)
        return api.cells(made.where(F.col("candidate") == name), "a").select(*KEYS, "y", "x", _six(F.col("a")).alias("alpha"))

    return build


_STEADY = gs.query("SELECT clip, frame_idx, y, x, " + gs.rnd("s") + " AS alpha FROM r0", o="SELECT *, row_number() OVER (PARTITION BY clip, y, x ORDER BY frame_idx) AS n FROM px",
                   r0="SELECT clip, frame_idx, y, x, n, a AS s FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.frame_idx, o.y, o.x, o.n, 0.5e0 * r0.s + 0.5e0 * o.a FROM r0 JOIN o ON o.clip = r0.clip AND o.y = r0.y AND o.x = r0.x AND o.n = r0.n + 1")
#: Engines of a nation's suppliers: which are ready, and which one was asked for.
_ENGINES = list(models.PRIORITY)


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table("supplier", "s_suppkey", "s_nationkey", "s_acctbal").frame(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(e) for e in _ENGINES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    asked = F.when(F.col("s_nationkey") % 3 == 0, F.lit("rembg")).when(F.col("s_nationkey") % 3 == 1, F.lit("auto"))
    return s.select(F.col("s_nationkey").alias("nation"), name.alias("engine"), (F.col("s_acctbal") > 1000).alias("ready"), asked.alias("requested"))


_ENGINE_SQL = ("WITH e AS (SELECT s_nationkey AS nation, s_suppkey % 5 AS k, s_acctbal > 1000 AS ready FROM supplier) SELECT nation, CASE WHEN nation % 3 = 0 THEN max(CASE WHEN k = 2 THEN 'rembg' END) ELSE ['gvm', 'corridorkey', 'rembg', 'birefnet', 'rvm'][min(CASE WHEN ready THEN k END) + 1] END AS engine FROM e GROUP BY nation")


# --- the pipeline


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the view's frames on a green screen, all steps and the recovery by the clip's screen colour."""
    d = owned(spark, sf_dir).withColumn("keyed", F.lit("green_screen"))
    return api.cells(process.decontaminated(d, Settings()), *COLOURS).select(*KEYS, "y", "x", *COLOURS)


def whole(settings: Settings):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, report = process.processed(frames(spark, sf_dir).drop("a"), settings)
        worst = F.array_max(F.transform("risks", lambda r: r["score"]))
        return report.select("clip", "frames", "keyed", "holes", "speckles", _six(F.col("edge")).alias("edge"), _six(F.col("overall_score")).alias("overall_score"), _six(worst).alias("worst_risk"))

    return build


def unknown_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames(spark, sf_dir)
    both = api.per_frame(d, lambda f: {"green": rules.green_alpha(f.picture), "black": rules.black_enhanced(f.picture, rules.black_base(f.picture))[0]}, "green array<double>, black array<double>", *COLOURS)
    s = process.unknown_scores(both, "green", "black")
    return s.select("clip", _six(F.col("green")).alias("green"), _six(F.col("black")).alias("black"), F.when(F.col("green") >= F.col("black"), "green").otherwise("black").alias("keyer"))


def _unknown_sql() -> str:
    each = lambda name: f"(SELECT clip, frame_idx, 1.2e0 * avg(CASE WHEN alpha > 0.95e0 THEN 1e0 ELSE 0e0 END) + 0.35e0 * least(avg(alpha), 0.65e0) - 0.3e0 * avg(CASE WHEN alpha > 0.05e0 AND alpha < 0.95e0 THEN 1e0 ELSE 0e0 END) - (CASE WHEN avg(CASE WHEN alpha > 0.01e0 THEN 1e0 ELSE 0e0 END) > 0.98e0 AND avg(CASE WHEN alpha > 0.95e0 THEN 1e0 ELSE 0e0 END) < 0.1e0 THEN 0.45e0 ELSE 0e0 END) AS s FROM ({FRAMED[name].sql()}) GROUP BY ALL)"
    return f"SELECT clip, {gs.rnd('avg(g.s)')} AS green, {gs.rnd('avg(b.s)')} AS black, CASE WHEN avg(g.s) >= avg(b.s) THEN 'green' ELSE 'black' END AS keyer FROM {each('p06_chroma_key')} g JOIN {each('p11_black_key')} b USING (clip, frame_idx) GROUP BY clip"


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row of each frame: means of all layers and alphas, over the frame and over entity, effect and transition, with the crop around the largest change."""
    def rule(f: Frame) -> dict:
        p, base, ai = f.picture, f["a"], f["ai"]
        sure = rules.subject_confidence(p, ai, base)
        gate = rules.smoothstep(sure, 0.45, 0.80)
        old_solid = np.maximum(rules.ai_solid_layer(p, ai, base), rules.solid_layer(p, base))
        old_effect = rules.effect_layer(p, base) * 0.7
        old = rules.clip(old_solid + old_effect * (1 - old_solid))
        new = rules.green_merged(p, base, ai, 0.7, "gvm")
        new_solid, new_effect = np.maximum.reduce([rules.ai_solid_layer(p, ai, base), ai * gate, rules.solid_layer(p, base)]), old_effect * (1 - 0.85 * gate)
        entity = gate >= 0.55
        effect = (p.effect >= 0.35) & (gate <= 0.35)
        parts = {"entity": entity, "effect": effect, "transition": ~entity & ~effect & (base > 0.02)}
        mean = lambda x, m: float(x[m].mean()) if m.any() else None
        change = np.abs(new - old)
        top = np.unravel_index(np.argmax(change), change.shape)
        peak = float(change[top])
        row = {"base_mean": float(base.mean()), "model_mean": float(ai.mean()), "old_mean": float(old.mean()), "new_mean": float(new.mean()), "mean_abs_diff": float(change.mean()), "confidence_mean": float(sure.mean()),
               "old_solid_mean": float(old_solid.mean()), "new_solid_mean": float(new_solid.mean()), "old_effect_mean": float(old_effect.mean()), "new_effect_mean": float(new_effect.mean())}
        for name, m in parts.items():
            row |= {f"{name}_pixels": int(m.sum())} | {f"{name}_{k}_mean": mean(x, m) for k, x in (("old", old), ("new", new), ("base", base), ("model", ai), ("confidence", sure))}
        br, blue = float(p.brightness[top]), (float(p.b[top] - p.g[top]), float(p.b[top] - p.r[top]))
        delta = mean(new, effect) - mean(ai, effect) if effect.any() else None
        risk = "cool_gray_transition_effect_risk" if br >= 192 and p.chroma[top] <= 48 and blue[0] >= 35 and blue[1] >= 40 and delta is not None and delta <= -0.03 else "bright_cool_effect_risk" if br >= 190 and blue[0] >= 30 and blue[1] >= 50 else None
        shown = peak >= 0.05
        return row | {"crop_y": int(top[0]) if shown else None, "crop_x": int(top[1]) if shown else None, "crop_peak": peak if shown else None, "effect_risk": risk if shown else None}

    parts = ", ".join(f"{n}_pixels long, " + ", ".join(f"{n}_{k}_mean double" for k in ("old", "new", "base", "model", "confidence")) for n in ("entity", "effect", "transition"))
    out = ", ".join(f"{k} double" for k in ("base_mean", "model_mean", "old_mean", "new_mean", "mean_abs_diff", "confidence_mean", "old_solid_mean", "new_solid_mean", "old_effect_mean", "new_effect_mean")) + f", {parts}, crop_y int, crop_x int, crop_peak double, effect_risk string"
    d = api.per_frame(frames(spark, sf_dir), rule, out, *BOTH, keep=("clip", "frame_idx"))
    return d.select(*[_six(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in d.schema])


# --- images and paths


def coded(*channels: str, scale: float = 1.0, cut: bool = False):
    """Frames as PNG contents, read again."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = images.encoded(frames(spark, sf_dir), *channels, scale=scale, cut=cut)
        return d.select(F.concat(F.lit("/clips/c"), F.col("clip").cast("string"), F.lit("/f_"), F.lpad(F.col("frame_idx").cast("string"), 9, "0"), F.lit(".png")).alias("path"), "content")

    return build


def exploded(d: DataFrame, *values: str) -> DataFrame:
    return api.cells(d, *values, keys=("path",)).select("path", "y", "x", *values)


_PATH = "'/clips/c' || clip || '/f_' || lpad(frame_idx::VARCHAR, 9, '0') || '.png'"


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files, some listed twice and some damaged, as sequences."""
    d = coded("r", "g", "b")(spark, sf_dir)
    k = F.regexp_extract("path", r"_0*([0-9]+)\.png$", 1).cast("long")
    odd = d.select("path", F.when(k % 5 == 0, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")).alias("content"))
    return images.sequences(odd.unionByName(odd.where(k % 2 == 0))).select("clip", "frame_idx", "path", "height", "width", "fps")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of output folders with some of the products."""
    k = F.col("p_partkey")
    product = F.element_at(F.array(*[F.lit(x) for x in ("/Matte/m_", "/FG/f_", "/Comp/c_", "/Processed/p_", "/frame_", "/other_")]), (k % 6 + 1).cast("int"))
    return table("part", "p_partkey", "p_size").frame(spark, sf_dir).select(F.concat(F.lit("/out/"), (F.col("p_size") * 3 % 17).cast("string"), F.when(k % 7 == 0, "/deep").otherwise(""), product, k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".png")).alias("path"))


_OUTPUTS = "o AS (SELECT '/out/' || (p_size * 3 % 17) || (CASE WHEN p_partkey % 7 = 0 THEN '/deep' ELSE '' END) AS output, p_partkey % 6 AS k, ['/Matte/m_', '/FG/f_', '/Comp/c_', '/Processed/p_', '/frame_', '/other_'][p_partkey % 6 + 1] || p_partkey || (CASE WHEN p_partkey % 11 = 0 THEN '.txt' ELSE '.png' END) AS rest, p_partkey FROM part)"


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products of a clip's first frames as one zip file; its names and checksums are read back."""
    import io
    import zipfile

    d = frames(spark, sf_dir)
    few = d.join(d.groupBy("clip").agg(F.min("frame_idx").alias("frame_idx")), KEYS)

    def pack(key, pdf):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values(["product", "frame_idx"]).itertuples():
                z.writestr(f"{r.product}/{r.frame_idx:09d}.png", bytes(r.content))
        with zipfile.ZipFile(data) as z:
            import pandas as pd

            return pd.DataFrame({"clip": key[0], "names": [",".join(z.namelist())], "ok": [z.testzip() is None]})

    out = process.products(few).groupBy("clip")
    return out.applyInPandas(pack, f"clip {d.schema['clip'].dataType.simpleString()}, names string, ok boolean")


def bilinear(side: int) -> str:
    src = lambda v: f"least(7e0, greatest(0e0, ({v} + 0.5e0) * 8 / {side} - 0.5e0))"
    return (f"WITH px AS ({PIXELS.sql()}), o AS (SELECT clip, frame_idx, oy::INT AS oy, ox::INT AS ox, {src('oy')} AS sy, {src('ox')} AS sx FROM (SELECT DISTINCT clip, frame_idx FROM px) CROSS JOIN range({side}) a(oy) CROSS JOIN range({side}) b(ox)), "
            "q AS (SELECT *, least(floor(sy), 6)::INT AS y0, least(floor(sx), 6)::INT AS x0 FROM o) SELECT q.clip, q.frame_idx, oy AS y, ox AS x, " + gs.rnd("sum(px.a * (CASE WHEN px.y = y0 THEN 1e0 - (sy - y0) ELSE sy - y0 END) * (CASE WHEN px.x = x0 THEN 1e0 - (sx - x0) ELSE sx - x0 END))")
            + " AS alpha FROM q JOIN px ON px.clip = q.clip AND px.frame_idx = q.frame_idx AND px.y IN (y0, y0 + 1) AND px.x IN (x0, x0 + 1) GROUP BY ALL")


def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphas at 13 x 13 cells; padded to a multiple of 32 and cut back on the way."""
    def rule(f: Frame) -> dict:
        a = rules.padded_to(rules.resized(f["a"], 13, 13))
        assert a.shape == (32, 32)
        return {"height": 13, "width": 13, "alpha": a[:13, :13]}

    d = api.per_frame(frames(spark, sf_dir), rule, "height int, width int, alpha array<double>", "a", keep=("clip", "frame_idx"))
    return api.cells(d, "alpha").select(*KEYS, "y", "x", _six(F.col("alpha")).alias("alpha"))


# --- texts


def stable_json(column: str = "raw"):
    """JSON with sorted keys, two spaces of indent and a newline at the end, floats rounded to six digits; as a column of texts."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def to_text(texts):
        def safe(v):
            if isinstance(v, dict):
                return {str(k): safe(x) for k, x in v.items()}
            if isinstance(v, list):
                return [safe(x) for x in v]
            return round(v, 6) if isinstance(v, float) else v

        return texts.map(lambda t: None if t is None else json.dumps(safe(json.loads(t)), ensure_ascii=False, indent=2, sort_keys=True) + "\n")

    return to_text(column)


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, document): the processing report of each clip, all fifteen sections, those without data in their default form."""
    q = api.quality(frames(spark, sf_dir))
    own = owned(spark, sf_dir)
    risk = api.risks(own, q).groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("risk", F.struct(F.round("score", 6).alias("score"), "level", "signals")))).alias("risks"))
    each = api.per_frame(own, lambda f: {r: int(f[r].sum()) for r in REGIONS}, ", ".join(f"{r} long" for r in REGIONS), *REGIONS)
    total = each.groupBy("clip").agg(*[F.sum(r).alias(r) for r in REGIONS])
    d = q.join(risk, "clip").join(total, "clip")
    none = lambda **kinds: F.from_json(F.lit(json.dumps(kinds)), ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'map<string,string>' if isinstance(v, dict) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in kinds.items()))
    six = lambda c: F.round(F.col(c), 6)
    sections = {
        "schema_version": F.lit(2), "job": F.struct(F.concat(F.lit("clip_"), F.col("clip").cast("string")).alias("input_path"), F.lit("out").alias("output_dir"), F.col("frames").alias("frame_count"), F.lit("auto").alias("background_mode_requested")),
        "timings": F.create_map().cast("map<string,double>"),
        "quality": F.struct(F.col("frames").alias("frame_count"), six("overall_score").alias("overall_score"), six("edge").alias("mean_edge_uncertainty"), F.col("speckles").alias("speckle_pixels"), F.col("holes").alias("hole_pixels"), six("residue").alias("background_residue"), six("flicker").alias("temporal_flicker")),
        "p0_risks": F.col("risks"), "regions": F.struct(*[F.col(r).alias(f"{r}_pixels") for r in REGIONS]),
        "region_supervision": F.struct(F.col("frames").alias("frame_count"), F.col("cells").alias("total_pixels"), F.struct(*[F.col(r) for r in REGIONS]).alias("region_pixels"), F.struct(*[F.round(F.col(r) / F.col("cells"), 6).alias(r) for r in REGIONS]).alias("region_ratios"), F.array().cast("array<string>").alias("failures")),
        "model_decisions": none(fallback_quality_metrics={}, fusion_quality_gate={}, green_screen_layer_debug_available=False), "fusion": none(available=False, selected_by_region={}, rejected_takeovers={}),
        "quality_selection": none(available=False, candidate_count=0, selected_model_counts={}, candidate_quality={}, skipped_candidates=[]),
        "edge_reconstruction": F.create_map().cast("map<string,string>"), "black_effect_enhancement": F.create_map().cast("map<string,string>"), "foreground_recovery": F.create_map().cast("map<string,string>"),
        "artifacts": F.create_map(F.lit("matte"), F.lit("Matte"), F.lit("fg"), F.lit("FG")), "warnings": F.array().cast("array<string>")}
    return d.select("clip", F.to_json(F.struct(*[v.alias(k) for k, v in sections.items()])).alias("raw")).select("clip", stable_json().alias("document"))


REGIONS = rules.REGIONS

#: Labels of the quality section of a report's view, with where each number stands and how it is shown.
QUALITY_LABELS = (("质量评分", "$.quality.overall_score", "%.3f"), ("边缘不确定性", "$.quality.mean_edge_uncertainty", "%.3f"), ("孔洞像素", "$.quality.hole_pixels", None), ("噪点像素", "$.quality.speckle_pixels", None), ("背景残留", "$.quality.background_residue", "%.3f"),
                  ("时序闪烁", "$.quality.temporal_flicker", "%.3f"), ("边缘时序闪烁", "$.quality.edge_temporal_flicker", "%.3f"), ("半透明时序闪烁", "$.quality.transparent_temporal_flicker", "%.3f"), ("最大帧差", "$.quality.max_frame_delta", "%.3f"), ("帧数", "$.job.frame_count", None), ("总耗时", "$.timings.total", "%.2fs"))
MODEL_LABELS = (("请求模型", "$.job.ai_model_requested"), ("实际模型", "$.model_decisions.active_ai_model"), ("背景模式", "$.job.background_mode_effective"), ("质量模式", "$.job.quality_mode"))
REGION_LABELS = (("subject", "主体"), ("hair_edge", "发丝边缘"), ("luminous_prop", "发光道具"), ("transparent_effect", "透明光效"), ("background_residue", "背景残留"), ("uncertain_edge", "不确定边缘"))
UNAVAILABLE = "报告不可用"


def view_sections(d: DataFrame) -> DataFrame:
    """Parsed reports with the texts of their view: quality, models, regions, recovery, fusion and selection, each with its fallback."""
    def shown(path: str, form: str | None):
        v = F.expr(f"try_variant_get(report, '{path}', 'double')")
        return F.coalesce(F.when(v.isNotNull(), F.format_string(form, v)) if form else v.cast("long").cast("string"), F.lit("N/A" if form else "0"))

    lines = lambda title, rows: F.concat_ws("\n", F.lit(f"**{title}**"), *rows)
    said = lambda label, text, *end: F.concat(F.lit(f"{label}："), text, *[F.lit(e) for e in end])
    text = lambda path: F.coalesce(F.expr(f"try_variant_get(report, '{path}', 'string')"), F.lit("N/A"))
    yes = lambda path: F.expr(f"coalesce(try_variant_get(report, '{path}', 'boolean'), false)")
    counts = F.expr("map_entries(coalesce(try_variant_get(report, '$.quality_selection.selected_model_counts', 'map<string,string>'), cast(map() as map<string,string>)))")
    chosen = F.when(F.size(counts) > 0, F.concat(F.lit("\n选中模型统计:\n"), F.array_join(F.transform(counts, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n"))).otherwise("")
    taken = F.expr("map_entries(coalesce(try_variant_get(report, '$.fusion.selected_by_region', 'map<string,string>'), cast(map() as map<string,string>)))")
    regions = F.when(F.size(taken) > 0, F.concat(F.lit("\n区域选择：\n"), F.array_join(F.transform(taken, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n"))).otherwise("")
    return d.withColumns({
        "quality_text": lines("质量摘要", [said(label, shown(path, form)) for label, path, form in QUALITY_LABELS]),
        "model_text": lines("模型决策", [said(label, text(path)) for label, path in MODEL_LABELS]),
        "region_text": lines("区域统计", [said(label, shown(f"$.regions.{r}_pixels", None), " px") for r, label in REGION_LABELS]),
        "recovery_text": F.when(F.expr("schema_of_variant(variant_get(report, '$.foreground_recovery', 'variant')) like 'OBJECT<%:%'"), lines("前景恢复", [said("处理帧数", shown("$.foreground_recovery.frames", None)), F.concat(F.lit("接受像素："), shown("$.foreground_recovery.accepted_pixels", None), F.lit(" / "), shown("$.foreground_recovery.attempted_pixels", None))])).otherwise("**前景恢复**\n无前景恢复诊断。"),
        "fusion_text": F.when(yes("$.fusion.available"), F.concat(F.lit("**融合诊断**"), regions)).otherwise("**融合诊断**\n无融合诊断。"),
        "selection_text": F.when(yes("$.quality_selection.available"), F.concat(F.lit("**质量选择**\n质量选择: 已启用\n候选数量: "), shown("$.quality_selection.candidate_count", None), chosen)).otherwise("**质量选择**\n质量选择: 未启用")})


def report_view(d: DataFrame) -> DataFrame:
    """(path, markdown): each report's view; one text where a report can't be read."""
    v = view_sections(d)
    parts = F.concat_ws("\n\n", F.lit("### 处理诊断报告"), "quality_text", "model_text", "region_text", "selection_text", "recovery_text", "fusion_text")
    return v.select("path", F.when(F.col("failure").isNotNull(), UNAVAILABLE).otherwise(parts).alias("markdown"))


def _view_sql(what: str) -> str:
    from alphaloom.operators.gates import _WITH

    shown = {"质量评分": "printf('%.3f', round(overall_score::DECIMAL(18,9), 3))", "边缘不确定性": "printf('%.3f', round(mean_edge_uncertainty::DECIMAL(18,9), 3))", "孔洞像素": "hole_pixels::BIGINT::VARCHAR", "噪点像素": "'0'", "背景残留": "printf('%.3f', round(background_residue::DECIMAL(18,9), 3))", "时序闪烁": "printf('%.3f', round(temporal_flicker::DECIMAL(18,9), 3))", "边缘时序闪烁": "printf('%.3f', round(edge_temporal_flicker::DECIMAL(18,9), 3))",
             "半透明时序闪烁": "printf('%.3f', round(transparent_temporal_flicker::DECIMAL(18,9), 3))", "最大帧差": "printf('%.3f', round(max_frame_delta::DECIMAL(18,9), 3))", "帧数": "CASE WHEN kind = 3 THEN '0' ELSE '3' END", "总耗时": "'N/A'"}
    text = "'**质量摘要**' || " + " || ".join(f"chr(10) || '{k}：' || {v}" for k, v in shown.items())
    if what == "loaded":
        return _WITH + "SELECT path, kind IN (1, 2) AS unavailable FROM f"
    if what == "quality":
        return _WITH + f"SELECT path, {text} AS quality_text, CASE WHEN kind = 3 THEN '**质量选择**' || chr(10) || '质量选择: 未启用' ELSE '**质量选择**' || chr(10) || '质量选择: 已启用' || chr(10) || '候选数量: ' || cands END AS selection_text, '**融合诊断**' || chr(10) || '无融合诊断。' AS fusion_text FROM f WHERE kind NOT IN (1, 2)"
    return _WITH + f"SELECT path, CASE WHEN kind IN (1, 2) THEN '{UNAVAILABLE}' ELSE '### 处理诊断报告' END AS title, CASE WHEN kind NOT IN (1, 2) THEN '质量评分：' || printf('%.3f', round(overall_score::DECIMAL(18,9), 3)) END AS score_line FROM f"


# --- jobs


def placed(jobs: DataFrame, order: list[str]) -> DataFrame:
    """Jobs with their place in one order over all of them: ranked within days, with the days before counted, so no task sorts everything."""
    d = jobs.withColumn("day_", F.to_date(order[0]))
    days = d.groupBy("day_").agg(F.count(F.lit(1)).alias("n_"))
    before = days.select("day_", F.coalesce(F.sum("n_").over(Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off_"))  # one row a day
    k = F.row_number().over(Window.partitionBy("day_").orderBy(*order))
    return d.withColumn("k_", k).join(before, "day_").withColumn("place", (F.col("k_") + F.col("off_")).cast("long")).drop("day_", "k_", "off_")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(JOBS.frame(spark, sf_dir).where("status in ('queued', 'completed')"), ["ts", "job_id"])


_QUEUE = f"SELECT *, row_number() OVER (ORDER BY ts, job_id) AS place FROM ({JOBS.sql()}) WHERE status IN ('queued', 'completed')"
_RESULT = "CASE WHEN job_type <> 'PROCESS_MEDIA' THEN 'failed' WHEN {} THEN 'cancelled' WHEN {} THEN 'failed' ELSE 'completed' END"


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queued job in the order of claims, with how its run ends: only PROCESS_MEDIA runs, a cancelled or failing run is told apart."""
    d = placed(JOBS.frame(spark, sf_dir).where("status <> 'completed'"), ["ts", "job_id"])
    result = F.when(F.col("job_type") != "PROCESS_MEDIA", "failed").when(F.col("status") == "cancelled", "cancelled").when(F.col("status") == "failed", "failed").otherwise("completed")
    return d.select("job_id", "place", result.alias("result"))


# --- the next frame's masks, which the last frame of a clip lacks


def following(spark: SparkSession, sf_dir: str, mask: str) -> DataFrame:
    d = api.numbered(owned(spark, sf_dir))
    after = d.select("clip", (F.col("n") - 1).alias("n"), F.col(mask).alias("after"), F.col("height").alias("h_"), F.col("width").alias("w_"))
    same = F.col("after").isNotNull() & (F.col("h_") == F.col("height")) & (F.col("w_") == F.col("width"))
    return d.select("clip", "frame_idx", "n", "height", "width", "a").join(after, ["clip", "n"], "left").withColumn("mask", F.when(same, F.col("after")))


def _following_sql(mask: str, shown: str) -> str:
    return f"WITH m AS (SELECT *, dense_rank() OVER (PARTITION BY clip ORDER BY frame_idx) AS n FROM ({MASKS.sql()})) SELECT p.clip, p.frame_idx, p.y, p.x, {shown} FROM m p LEFT JOIN m q ON q.clip = p.clip AND q.n = p.n + 1 AND q.y = p.y AND q.x = p.x"


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = following(spark, sf_dir, "subject").withColumn("known", F.transform("a", lambda _: F.col("mask").isNotNull())).withColumn("subject", F.coalesce("mask", F.transform("a", lambda _: F.lit(None).cast("boolean"))))
    return api.cells(d, "subject", "known").select(*KEYS, "y", "x", "subject", "known")


def safe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = following(spark, sf_dir, "hair_edge").withColumn("mask", F.coalesce("mask", F.transform("a", lambda _: F.lit(False))))
    return api.cells(d, "mask").select(*KEYS, "y", "x", "mask")


def recovered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose subject a model lost, and clips of which that is true of enough frames."""
    def rule(f: Frame) -> dict:
        p, base, ai = f.picture, f["a"], f["ai"] * (0.05 if f["frame_idx"] % 3 else 1.0)
        mask = rules.fallback_mask(p, base)
        return {"hit": rules.lost_subject(ai, base, mask), "broad": rules.broadly_lost(p, ai, base), "alpha": float(rules.subject_recovered(p, ai, base).mean())}

    return api.per_frame(frames(spark, sf_dir), rule, "hit boolean, broad boolean, alpha double", *BOTH)


def _lost_sql(clips: bool = False) -> str:
    steps = {"m": f"SELECT clip, frame_idx, y, x, a, ai * (CASE WHEN frame_idx % 3 <> 0 THEN 0.05e0 ELSE 1e0 END) AS ai, subject_like FROM ({PIXELS.sql()}) JOIN (SELECT clip, frame_idx, y, x, subject_like FROM ({POINTS['f18_gvm_fallback_mask'].sql()})) USING (clip, frame_idx, y, x)"}
    step = lambda x, lo, hi: f"(least(1e0, greatest(0e0, ({x} - {lo}e0) / {hi - lo!r}e0)) * least(1e0, greatest(0e0, ({x} - {lo}e0) / {hi - lo!r}e0)) * (3e0 - 2e0 * least(1e0, greatest(0e0, ({x} - {lo}e0) / {hi - lo!r}e0))))"
    steps["h"] = f"SELECT clip, frame_idx, coalesce(avg(CASE WHEN subject_like THEN {step('ai', 0.25, 0.70)} END) < 0.08e0 AND avg(CASE WHEN subject_like THEN {step('a', 0.30, 0.72)} END) >= 0.35e0, false) AS hit FROM m GROUP BY ALL"
    if clips:
        steps["e"] = f"SELECT clip, frame_idx, avg(m.ai) < 0.06e0 AND avg(CASE WHEN wide THEN 1e0 ELSE 0e0 END) >= 0.18e0 AND avg(CASE WHEN m.a > 0.08e0 AND m.a < 0.75e0 THEN 1e0 ELSE 0e0 END) >= 0.2e0 AND coalesce(avg(CASE WHEN wide THEN ew END) < 0.65e0, false) AS broad FROM (SELECT *, NOT {gs.SCREEN} AND {step('a', 0.20, 0.50)} > 0.3e0 AS wide FROM ({LAYERS.sql()})) l JOIN (SELECT clip, frame_idx, y, x, m.ai, m.a FROM m) m USING (clip, frame_idx, y, x) GROUP BY ALL".replace("m.ai, m.a FROM m)", "ai AS ai, a AS a FROM m)")
        return gs.query("SELECT clip, count(CASE WHEN hit THEN 1 END) AS hits, count(CASE WHEN broad AND NOT hit THEN 1 END) AS broad, greatest(count(CASE WHEN hit THEN 1 END), count(CASE WHEN broad AND NOT hit THEN 1 END)) >= greatest(2, (count(*) + 1) // 2) AS degenerate FROM h JOIN e USING (clip, frame_idx) GROUP BY clip", **steps)
    return gs.query(f"SELECT clip, frame_idx, hit, {gs.rnd('avg(CASE WHEN hit AND subject_like THEN greatest(ai, least(1e0, a * 0.98e0)) ELSE ai END)')} AS mean_alpha FROM m JOIN h USING (clip, frame_idx) GROUP BY ALL", **steps)


# --- SQL of light and its halos on the view's 8 x 8 frames


def _grouped(name: str, source: str, cond: str, least: int) -> dict[str, str]:
    """Steps to <name>: cells of components of at least so many cells."""
    at = "m.clip = k.clip AND m.frame_idx = k.frame_idx"
    return {f"{name}_m": f"SELECT {gs.KEYS} FROM {source} WHERE {cond}", f"{name}_l": f"SELECT {gs.KEYS}, y * 8 + x AS l FROM {name}_m UNION SELECT m.clip, m.frame_idx, m.y, m.x, k.l FROM {name}_l k JOIN {name}_m m ON {at} AND abs(m.y - k.y) <= 1 AND abs(m.x - k.x) <= 1",
            name: f"SELECT {gs.KEYS} FROM (SELECT *, count(*) OVER (PARTITION BY clip, frame_idx, l) AS area FROM (SELECT {gs.KEYS}, min(l) AS l FROM {name}_l GROUP BY {gs.KEYS})) WHERE area >= {least}"}


_GLARE = f"(((br > 205 AND ch < 70) OR (br > 185 AND b > 150 AND g > 140 AND r > 130 AND ch < 95) OR (r > 200 AND g > 155 AND b > 90 AND br > 165)) AND NOT {gs.SCREEN})"
_PURPLE = "(r > 120 AND b > 130 AND g < 180)"


def _core(cond: str) -> dict[str, str]:
    """Steps to co(.., core): large components of a condition, closed."""
    return {**_grouped("big", "px", cond, 12), "c0": f"SELECT px.*, b.y IS NOT NULL AS kept FROM px LEFT JOIN big b USING ({gs.KEYS})", "c1": gs.near("c0", gs.ellipse(5), grown="bool_or(n.kept)"),
            "c2": gs.near("c1", gs.ellipse(5), core="bool_and(n.grown)"), "co": f"SELECT px.*, core FROM px JOIN c2 USING ({gs.KEYS})"}


_EVIDENCE = gs.query(f"SELECT {gs.KEYS}, NOT core AND NOT (reach AND NOT core AND b > 140 AND g > 120 AND r < 155 AND br > 120 AND a < 0.45e0 AND NOT {_PURPLE} AND NOT {gs.SCREEN}) AND NOT {_PURPLE} AND NOT {gs.SCREEN} AND b > 80 AND g > 120 AND r < 170 AND br > 80 AS evidence FROM co JOIN rc USING ({gs.KEYS})",
                     **_core(f"{_GLARE} AND NOT {_PURPLE}"), rc=gs.near("co", gs.ellipse(25), reach="bool_or(n.core)"))


def _ramp(x: str, lo: float, hi: float) -> str:
    t = f"least(1e0, greatest(0e0, ({x} - {lo}e0) / {hi - lo!r}e0))"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


_LIGHT = {**_core(_GLARE), "h1": gs.near("co", gs.ellipse(11), beside="bool_or(n.core)"), "h2": gs.near("co", gs.ellipse(25), reach="bool_or(n.core)", dist="min(CASE WHEN n.core THEN sqrt((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x)) END)"),
          "li": f"SELECT {gs.KEYS}, least(1e0, greatest(CASE WHEN core THEN 1e0 ELSE 0e0 END, CASE WHEN beside AND ((br > 145 AND ch < 120) OR (b > 135 AND g > 105 AND r > 95) OR (r > 185 AND g > 120)) AND NOT {gs.SCREEN} THEN 0.34e0 * {_ramp('br / 255e0', 0.42, 0.82)} ELSE 0e0 END, "
          f"CASE WHEN reach AND NOT core AND b > 140 AND g > 120 AND r < 150 AND br > 120 AND a < 0.45e0 AND NOT {gs.SCREEN} THEN (0.36e0 + 0.18e0 * greatest(0e0, (14e0 - dist) / 14e0)) * {_ramp('br / 255e0', 0.42, 0.72)} ELSE 0e0 END)) AS light FROM co JOIN h1 USING ({gs.KEYS}) JOIN h2 USING ({gs.KEYS})"}


def _merged_sql() -> str:
    cells = LAYERS.select("clip", "frame_idx", "y", "x", subj=f"greatest({px.pick(AI_SOLID, 'ai')}, ai * {GATE})", sol=px.one(SOLID), conf="sc")
    effects = EFFECT_LAYER.select("clip", "frame_idx", "y", "x", eff="effect")
    return gs.query(gs.shown(f"(SELECT {gs.KEYS}, greatest(subj, sol) AS s, greatest(eff * 0.7e0 * (1e0 - 0.85e0 * {_ramp('conf', 0.45, 0.80)}), light * 0.7001e0, CASE WHEN w.y IS NOT NULL THEN greatest(a, 0.98e0) ELSE 0e0 END) AS e FROM px JOIN sj USING ({gs.KEYS}) JOIN ef USING ({gs.KEYS}) JOIN li USING ({gs.KEYS}) LEFT JOIN wa w USING ({gs.KEYS}))",
                             alpha="least(1e0, greatest(0e0, s + e * (1e0 - s)))"),
                    sj=cells.sql(), ef=effects.sql(), **_LIGHT, **_grouped("wa", "px", f"a >= 0.6e0 AND {gs.WARM} AND NOT {gs.SCREEN}", 12))


def _black_spill_sql() -> str:
    """Lift, HSV and back, in 8-bit steps."""
    up = lambda c: f"floor(least(255e0, greatest(0e0, {c} + lift)))"
    band = "(a > 0.02e0 AND a < 0.75e0)"
    steps = {
        "q0": "SELECT *, greatest(0e0, 50e0 - br) * 0.6e0 * (1e0 - a) * 0.3e0 * (CASE WHEN a > 0.05e0 AND a < 0.95e0 AND br < 60 THEN 1e0 ELSE 0e0 END) AS lift FROM px",
        "q1": f"SELECT *, {up('r')} AS r1, {up('g')} AS g1, {up('b')} AS b1 FROM q0", "q2": "SELECT *, greatest(r1, g1, b1) AS t, greatest(r1, g1, b1) - least(r1, g1, b1) AS d FROM q1",
        "q3": "SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN t = r1 THEN 60e0 * (g1 - b1) / d WHEN t = g1 THEN 120e0 + 60e0 * (b1 - r1) / d ELSE 240e0 + 60e0 * (r1 - g1) / d END AS h0, floor(CASE WHEN t > 0 THEN 255e0 * d / t ELSE 0e0 END + 0.5e0) AS s0 FROM q2",
        "q4": "SELECT *, floor((CASE WHEN h0 < 0 THEN h0 + 360e0 ELSE h0 END) / 2e0 + 0.5e0) AS h1 FROM q3", "q5": "SELECT *, CASE WHEN h1 >= 180 THEN h1 - 180 ELSE h1 END AS h, CASE WHEN a > 0.1e0 AND s0 < 50 AND t > 15 AND ch < 15 THEN least(255e0, s0 * 1.2e0) ELSE s0 END AS s1, CASE WHEN a > 0.05e0 AND t < 60 AND t > 5 THEN least(255e0, t * 1.08e0) ELSE t END AS v1 FROM q4",
        "q6": f"SELECT *, CASE WHEN {band} AND v1 < 70 AND v1 > 5 THEN least(255e0, v1 + least(18e0, greatest(0e0, (78e0 - v1) * 0.35e0))) ELSE v1 END AS v2, CASE WHEN {band} AND s1 < 32 AND ch < 18 AND v1 > 10 THEN least(255e0, s1 + least(18e0, greatest(0e0, (40e0 - s1) * 0.45e0))) ELSE s1 END AS s2 FROM q5",
        "q7": "SELECT *, h / 30e0 AS sec, floor(s2) / 255e0 AS s, floor(v2) AS v FROM q6", "q8": "SELECT *, floor(sec)::INT % 6 AS k, sec - floor(sec) AS f FROM q7",
        "q9": "SELECT *, v * (1e0 - s) AS p_, v * (1e0 - s * f) AS q_, v * (1e0 - s * (1e0 - f)) AS t_ FROM q8",
        "qa": "SELECT *, floor([v, q_, p_, p_, t_, v][k + 1] + 0.5e0) AS r2, floor([t_, v, v, q_, p_, p_][k + 1] + 0.5e0) AS g2, floor([p_, p_, t_, v, v, q_][k + 1] + 0.5e0) AS b2, a > 0.1e0 AND br < 40 AND ch > 10 AS own FROM q9",
        "qb": "SELECT *, " + ", ".join(f"CASE WHEN own THEN floor({c}2 * 0.7e0 + {c} * 0.3e0) ELSE {c}2 END AS {c}3" for c in "rgb") + " FROM qa",
        "qc": f"SELECT *, CASE WHEN {band} AND (r3 + g3 + b3) / 3e0 < 52 THEN least(10e0, greatest(0e0, (58e0 - (r3 + g3 + b3) / 3e0) * 0.35e0)) ELSE 0e0 END AS more FROM qb"}
    return gs.query(gs.shown("qc", **{n: f"floor(least(255e0, greatest(0e0, {c}3 + more * {w}e0)))" for n, c, w in (("red", "r", 0.85), ("green", "g", 1.0), ("blue", "b", 0.9))}), **steps)



OPS: dict[str, Relation] = {
    "f06_region_luminous": pixels(lambda f: {"luminous": rules.luminous(f.picture, f["a"])}, ALL, _luminous_sql(), None, luminous="boolean"),
    "f20_background_evidence": pixels(lambda f: {"evidence": rules.background_evidence(f.picture, f["a"])}, ALL, _EVIDENCE, None, evidence="boolean"),
    "f21_document_evidence": counted(lambda e: [rules.document_evidence(e.p, e.of("a"))], "evidence"),
    "f22_luminous_reconstruct": pixels(lambda f: {"layer": rules.luminous_reconstruction(f.picture, f["a"])}, ALL, gs.query(gs.shown("li", layer="light"), **_LIGHT), None, layer="double"),
    "f25_subject_integrity": counted(_integrity, "layer"),
    "f26_subject_instance": counted(lambda e: [rules.subject_instance(gate_of(e) >= 0.75)], "instance"),
    "f27_subject_core": counted(lambda e: [rules.subject_core(*[np.maximum(gate_of(e), e.of("a") >= 0.5)] * 3, e.of("ai") * 0.4)], "core"),
    "n06_fill_holes": pixels(_holes, BOTH, _HOLES, None, whole="boolean", allowed="boolean"),
    "n15_boxfilter": pixels(lambda f: {"mean": grid.boxed(f["a"], 3), "wide": grid.boxed(f["a"], 5)}, A, gs.query(gs.shown(f"(SELECT *, s3 / 9e0 AS v, s5 / 25e0 AS w FROM b3 JOIN b5 USING ({gs.KEYS}))", mean="v", wide="w"), b3=gs.filtered("px", gs.ones(3), "a", "s3"), b5=gs.filtered("px", gs.ones(5), "a", "s5")), None, mean="double", wide="double"),
    "p27_black_despill": pixels(lambda f: dict(zip(("red", "green", "blue"), rules.black_spill_removed(f.picture, f["a"]))), ALL, _black_spill_sql(), None, red="double", green="double", blue="double"),
    "p45_input_rescale": query(rescaled, bilinear(13)),
    "p46_extract_alpha": pixels(lambda f: {"alpha": models.checked({"matte": (f["a"] * 255)[None, :, :, None]} if f["frame_idx"] % 2 else [f["a"]], f.shape)}, A, gs.query(gs.shown("(SELECT *, max(a) OVER (PARTITION BY clip, frame_idx) AS top FROM px)", alpha="CASE WHEN frame_idx % 2 = 1 AND top * 255 <= 1 THEN a * 255 ELSE a END")), None, alpha="double"),
    "w04_flow_smooth": query(lambda s, d: api.cells(api.stabilise(frames(s, d), "high"), "alpha").select(*KEYS, "y", "x", _six(F.col("alpha")).alias("alpha")), None),
    "w05_stabilize_dispatch": query(lambda s, d: api.stabilise(frames(s, d).where("clip % 2 = 0"), "fast").unionByName(api.stabilise(frames(s, d).where("clip % 2 = 1"), "standard")).transform(lambda x: api.cells(x, "alpha")).select(*KEYS, "y", "x", _six(F.col("alpha")).alias("alpha")),
                                   f"SELECT * FROM ({FRAMED['w02_ema'].sql()}) WHERE clip % 2 = 0 UNION ALL SELECT * FROM ({FRAMED['w03_adaptive_bidirectional'].sql()}) WHERE clip % 2 = 1"),
    "w06_recurrent_model": query(model_alphas("rvm"), _STEADY),
    "u02_generator_protocol": query(lambda s, d: generated(s, d)[0].groupBy("candidate").agg(F.count(F.lit(1)).alias("frames")), f"SELECT unnest(['traditional', 'birefnet', 'rvm']) AS candidate, (SELECT count(DISTINCT frame_idx) FROM ({PIXELS.sql()})) AS frames"),
    "u03_quality_driven": query(driven, None),
    "u04_skip_reasons": query(lambda s, d: generated(s, d)[1].select("clip", "name", "reason"), f"SELECT DISTINCT clip, x.name, x.reason FROM ({PIXELS.sql()}), (VALUES ('sam2', 'guidance_missing'), ('gvm', 'model_unavailable'), ('matanyone2', 'generation_failed'), ('rembg', 'disabled_by_config')) AS x(name, reason)"),
    "u06_birefnet_candidate": query(model_alphas("birefnet"), gs.query(gs.shown("(SELECT *, max(ai) OVER (PARTITION BY clip, frame_idx) AS top FROM px)", alpha="CASE WHEN top * 255 <= 1 THEN ai * 255 ELSE ai END"))),
    "u11_hybrid_dispatch": query(whole(Settings(quality="fast")), None),
    "u12_green_path": pixels(lambda f: {"alpha": rules.green_merged(f.picture, f["a"], f["ai"])}, BOTH, _merged_sql(), None, alpha="double"),
    "u14_unknown_path": query(unknown_choice, _unknown_sql()),
    "u17_decontaminate": query(decontaminated, None),
    "u20_recover_degenerate": query(lambda s, d: recovered_frames(s, d).select(*KEYS, "hit", _six(F.col("alpha")).alias("mean_alpha")), _lost_sql()),
    "a33_degenerate_sequence": query(lambda s, d: recovered_frames(s, d).groupBy("clip").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("broad") & ~F.col("hit")).alias("broad"), F.count(F.lit(1)).alias("n")).select(
        "clip", "hits", "broad", (F.greatest("hits", "broad") >= F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))).alias("degenerate")), _lost_sql(True)),
    "u23_region_context": query(lambda s, d: api.cells(owned(s, d), *REGIONS).select(*KEYS, "y", "x", *[F.col(a).alias(b) for a, b in VIEWED.items()]), gs.MASKED),
    "u24_pipeline_process": query(whole(Settings(quality="standard", despeckle_radius=1)), None),
    "u25_model_post": pixels(lambda f: {"alpha": models.checked(None if f["frame_idx"] % 5 == 0 else {"pha": f["ai"] * 1.5 - 0.2}, f.shape)}, ("ai",), gs.query(gs.shown("(SELECT *, max(ai * 1.5e0 - 0.2e0) OVER (PARTITION BY clip, frame_idx) AS top FROM px)", alpha="CASE WHEN frame_idx % 5 = 0 THEN 1e0 WHEN top > 1 THEN greatest(0e0, least(1e0, (ai * 1.5e0 - 0.2e0) / 255e0)) ELSE greatest(0e0, ai * 1.5e0 - 0.2e0) END")), None, alpha="double"),
    "u27_quality_history_copy": query(FRAMED["a24_black_effect_history"].build, FRAMED["a24_black_effect_history"]),
    "a40_sample_diagnostics": query(diagnosed, None),
    "r13_priority_sort": query(lambda s, d: diagnosed(s, d).where("crop_peak is not null").withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy(F.col("crop_peak").desc(), "frame_idx")).cast("long")).select(
        "clip", "frame_idx", "place", F.col("crop_peak").alias("peak"), F.first("effect_risk", ignorenulls=True).over(Window.partitionBy("clip").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("dominant_risk")), None),
    "r14_engine_priority": query(lambda s, d: models.first_ready(engines(s, d), "nation"), _ENGINE_SQL),
    "u21_model_loading": query(lambda s, d: models.first_ready(engines(s, d).withColumn("requested", F.lit(None).cast("string")), "nation", order=models.FALLBACK, exclude="rembg"),
                               "SELECT s_nationkey AS nation, ['gvm', 'corridorkey', 'rembg', 'birefnet', 'rvm'][min(CASE WHEN s_acctbal > 1000 AND s_suppkey % 5 IN (1, 3, 4) THEN s_suppkey % 5 END) + 1] AS engine FROM supplier GROUP BY s_nationkey"),
    "s03_image_scan": query(lambda s, d: exploded(images.decoded(coded("r", "g", "b")(s, d)), *COLOURS), f"SELECT {_PATH} AS path, y, x, r, g, b FROM ({PIXELS.sql()})"),
    "s04_sequence_scan": query(sequence, f"SELECT '/clips/c' || clip AS clip, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS frame_idx, path, 8::INT AS height, 8::INT AS width, 30::DOUBLE AS fps FROM (SELECT DISTINCT clip, frame_idx, {_PATH} AS path FROM ({PIXELS.sql()}) WHERE frame_idx % 5 <> 0)"),
    "s13_alpha_image_scan": query(lambda s, d: exploded(images.alpha_values(coded("a", scale=255.0, cut=True)(s, d)), "a").select("path", "y", "x", _six(F.col("a")).alias("alpha")),
                                  f"SELECT path, y, x, {gs.rnd('CASE WHEN max(v) OVER (PARTITION BY path) > 1 THEN v / 255e0 ELSE v END')} AS alpha FROM (SELECT {_PATH} AS path, y, x, floor(a * 255e0) AS v FROM ({PIXELS.sql()}))"),
    "s14_first_matte_pick": query(lambda s, d: images.first_mattes(outputs(s, d)), f"WITH {_OUTPUTS} SELECT output, min(output || rest) AS path FROM o WHERE k = 0 AND rest LIKE '%.png' GROUP BY output"),
    "s16_preview_frame_scan": query(lambda s, d: images.preview_frames(outputs(s, d)), f"WITH {_OUTPUTS} SELECT output, ['Processed', 'Comp', 'FG', 'Matte', ''][rank] AS product, path FROM (SELECT output, [4, 3, 2, 1, 5][k + 1] AS rank, output || rest AS path, row_number() OVER (PARTITION BY output ORDER BY [4, 3, 2, 1, 5][k + 1], output || rest) AS n FROM o WHERE k < 5 AND rest LIKE '%.png') WHERE n = 1"),
    "k02_encode_gray": query(lambda s, d: exploded(images.decoded(coded("a", scale=255.0)(s, d)), "r").select("path", "y", "x", F.col("r").alias("gray")), f"SELECT {_PATH} AS path, y, x, round_even(a * 255e0, 0) AS gray FROM ({PIXELS.sql()})"),
    "k01_encode_rgba": query(lambda s, d: exploded(images.decoded(images.encoded(frames(s, d).withColumn("a255", F.transform("a", lambda v: v * 255)), "r", "g", "b", "a255").select(F.concat(F.lit("/clips/c"), F.col("clip").cast("string"), F.lit("/f_"), F.lpad(F.col("frame_idx").cast("string"), 9, "0"), F.lit(".png")).alias("path"), "content")), "r", "alpha").select("path", "y", "x", F.col("r").alias("red"), "alpha"),
                             f"SELECT {_PATH} AS path, y, x, r AS red, round_even(a * 255e0, 0) AS alpha FROM ({PIXELS.sql()})"),
    "k03_compose_output": query(lambda s, d: exploded(images.decoded(process.products(frames(s, d)).select(F.concat_ws("/", F.lit(""), F.col("clip").cast("string"), F.col("frame_idx").cast("string"), "product").alias("path"), "content")), *COLOURS),
                                f"SELECT '/' || clip || '/' || frame_idx || '/' || p AS path, y, x, CASE p WHEN 'Matte' THEN m WHEN 'Comp' THEN round_even(r * a, 0) ELSE r END AS r, CASE p WHEN 'Matte' THEN m WHEN 'Comp' THEN round_even(g * a, 0) ELSE g END AS g, CASE p WHEN 'Matte' THEN m WHEN 'Comp' THEN round_even(b * a, 0) ELSE b END AS b FROM (SELECT *, floor(a * 255e0) AS m FROM ({PIXELS.sql()})) CROSS JOIN (SELECT unnest(['FG', 'Matte', 'Comp', 'Processed']) AS p)"),
    "k12_zip_outputs": query(zipped, f"SELECT clip, 'Comp/' || f || '.png,FG/' || f || '.png,Matte/' || f || '.png,Processed/' || f || '.png' AS names, true AS ok FROM (SELECT clip, lpad(min(frame_idx)::VARCHAR, 9, '0') AS f FROM ({PIXELS.sql()}) GROUP BY clip)"),
    "k04_report_write": query(lambda s, d: report_documents(s, d).select("clip", F.substring_index("document", "\n", 2).alias("head"), F.col("document").endswith("\n}\n").alias("ends"), F.get_json_object("document", "$.quality.hole_pixels").cast("long").alias("holes"), F.get_json_object("document", "$.quality.overall_score").cast("double").alias("overall_score")),
                              f"SELECT clip, '{{' || chr(10) || '  \"artifacts\": {{' AS head, true AS ends, holes, round(overall_score, 6) AS overall_score FROM ({AGGREGATES['a01'].sql()})"),
    "x16_report_build": query(lambda s, d: report_documents(s, d).select("clip", F.array_join(F.array_sort(F.json_object_keys("document")), ",").alias("sections"), F.get_json_object("document", "$.p0_risks.hair_edge_loss.level").alias("hair"), F.get_json_object("document", "$.regions.subject_pixels").cast("long").alias("subject_pixels")),
                              f"SELECT clip, 'artifacts,black_effect_enhancement,edge_reconstruction,foreground_recovery,fusion,job,model_decisions,p0_risks,quality,quality_selection,region_supervision,regions,schema_version,timings,warnings' AS sections, level AS hair, subject_pixels FROM ({AGGREGATES['a11'].sql()}) JOIN (SELECT clip, count(CASE WHEN subject THEN 1 END) AS subject_pixels FROM ({MASKS.sql()}) GROUP BY clip) USING (clip)"),
    "x30_report_sections": query(lambda s, d: report_documents(s, d).select("clip", *[F.regexp_replace(F.get_json_object("document", f"$.{k}"), r"\s", "").alias(k) for k in ("fusion", "quality_selection", "model_decisions", "artifacts", "black_effect_enhancement")]),
                                 f"SELECT DISTINCT clip, '{{\"available\":false,\"rejected_takeovers\":{{}},\"selected_by_region\":{{}}}}' AS fusion, '{{\"available\":false,\"candidate_count\":0,\"candidate_quality\":{{}},\"selected_model_counts\":{{}},\"skipped_candidates\":[]}}' AS quality_selection, '{{\"fallback_quality_metrics\":{{}},\"fusion_quality_gate\":{{}},\"green_screen_layer_debug_available\":false}}' AS model_decisions, '{{\"fg\":\"FG\",\"matte\":\"Matte\"}}' AS artifacts, '{{}}' AS black_effect_enhancement FROM ({PIXELS.sql()})"),
    "x01_json_safe": query(lambda s, d: table("events", "event_id", "value").frame(s, d).select("event_id", stable_json(F.concat(F.lit('{"b": [1, {"v": '), F.coalesce(F.col("value"), F.lit(0.0)).cast("string"), F.lit('}], "a": 0.12345678}'))).alias("text")).select("event_id", F.get_json_object("text", "$.b[1].v").cast("double").alias("value"), F.get_json_object("text", "$.a").alias("rounded"), F.col("text").startswith('{\n  "a"').alias("ordered")),
                           "SELECT event_id, round(coalesce(value, 0e0), 6) AS value, '0.123457' AS rounded, true AS ordered FROM events"),
    "x15_report_view": query(lambda s, d: report_view(regression.parsed(reports(s, d))).select("path", F.substring_index("markdown", "\n", 1).alias("title"), F.nullif(F.regexp_extract("markdown", "(质量评分：[^\\n]*)", 1), F.lit("")).alias("score_line")), _view_sql("view")),
    "x31_report_load_view": query(lambda s, d: report_view(regression.parsed(reports(s, d))).select("path", (F.col("markdown") == UNAVAILABLE).alias("unavailable")), _view_sql("loaded")),
    "x29_report_view_sections": query(lambda s, d: view_sections(regression.parsed(reports(s, d)).where("failure is null")).select("path", "quality_text", "selection_text", "fusion_text"), _view_sql("quality")),
    "w09_queue_fifo": query(lambda s, d: queue(s, d).select("job_id", "place", (F.col("place") == 1).alias("runs_now")), f"SELECT job_id, place, place = 1 AS runs_now FROM ({_QUEUE})"),
    "w12_history_clear": query(lambda s, d: JOBS.frame(s, d).groupBy("path").agg(F.count_if(F.col("status").isin("completed", "failed", "cancelled")).alias("removed"), F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(~F.col("status").isin("completed", "failed", "cancelled"), F.col("job_id"))))), lambda j: j.cast("string")), ",").alias("left_")),
                               f"SELECT path, count(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 1 END) AS removed, coalesce(string_agg(CASE WHEN status NOT IN ('completed', 'failed', 'cancelled') THEN job_id::VARCHAR END, ',' ORDER BY job_id), '') AS left_ FROM ({JOBS.sql()}) GROUP BY path"),
    "w17_worker_step": query(lambda s, d: drained(s, d).where("place = 1").select("job_id", "result"), f"SELECT job_id, {_RESULT.format("status = 'cancelled'", "status = 'failed'")} AS result FROM (SELECT *, row_number() OVER (ORDER BY ts, job_id) AS place FROM ({JOBS.sql()}) WHERE status <> 'completed') WHERE place = 1"),
    "w19_run_all_jobs": query(drained, f"SELECT job_id, row_number() OVER (ORDER BY ts, job_id) AS place, {_RESULT.format("status = 'cancelled'", "status = 'failed'")} AS result FROM ({JOBS.sql()}) WHERE status <> 'completed'"),
    "j02_ownership_lookup": query(looked_up, _following_sql("subject", "q.subject AS subject, q.clip IS NOT NULL AS known")),
    "f17_ownership_mask_safe": query(safe_mask, _following_sql("hair", "coalesce(q.hair, false) AS mask")),
    "j13_region_failures_from_report": query(lambda s, d: table("documents", "doc_id", "n_chars").frame(s, d).join(table("labels", "doc_id", "quality", "toxic").frame(s, d), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "region_supervision report missing").when(F.col("quality") == 0, "quality below minimum").when(F.col("toxic") == 1, "toxic region").otherwise("").alias("failure")),
                                             "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'region_supervision report missing' WHEN quality = 0 THEN 'quality below minimum' WHEN toxic = 1 THEN 'toxic region' ELSE '' END AS failure FROM documents d LEFT JOIN labels USING (doc_id)"),
    "j14_shape_alignment_checks": query(lambda s, d: candidates(s, d).select(*KEYS, "candidate", F.size("a").alias("cells")).join(frames(s, d).select(*KEYS, "height", "width"), KEYS, "full_outer").groupBy(*KEYS).agg(F.count_if(F.col("cells").isNull() | F.col("height").isNull() | (F.col("cells") != F.col("height") * F.col("width"))).alias("missing"), F.count("candidate").alias("candidates")),
                                        f"SELECT clip, frame_idx, 0::BIGINT AS missing, 3::BIGINT AS candidates FROM ({PIXELS.sql()}) GROUP BY clip, frame_idx"),
    "x24_region_expectation_parse": query(lambda s, d: table("part", "p_partkey").frame(s, d).select("p_partkey", F.from_json(F.concat(F.lit('{"required_regions": ["subject", "'), F.element_at(F.array(*[F.lit(x) for x in ("hair_edge", "sky", "uncertain_edge")]), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit('"]}')), "required_regions array<string>").alias("e"))
                                          .select("p_partkey", F.array_join(F.array_except("e.required_regions", F.array(*[F.lit(r) for r in REGIONS])), ",").alias("unsupported")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'sky' ELSE '' END AS unsupported FROM part"),
}

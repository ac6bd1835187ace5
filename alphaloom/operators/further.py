"""Queries of ranking, tracking, sequence models, debug texts and diagnoses of whole inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.frames import api, models, rules
from alphaloom.frames.api import KEYS, Frame
from alphaloom.operators.aggregates import AUTO, FORMS as AGGREGATES
from alphaloom.operators.framed import ALL, BOTH, COLOURS, VIEWED, _NAMED, _SELECT_STEPS, _six, candidates, frames, owned, pixels, query, selection
from alphaloom.operators.gates import assets
from alphaloom.operators.stages import diagnosed
from alphaloom.plans import grid_sql as gs
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import PIXELS
from alphaloom.reports import manifests
from alphaloom.sources import images

REGIONS = rules.REGIONS


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion of each region that a frame has, with its rank."""
    made = candidates(spark, sf_dir).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ord", "candidate", "a"))).alias("of"))
    d = owned(spark, sf_dir).join(made, KEYS).withColumns({"names": F.transform("of", lambda c: c["candidate"]), "values": F.flatten(F.transform("of", lambda c: c["a"]))})

    def rule(f: Frame) -> dict:
        own, alphas = f.own(), f.row["values"].reshape(-1, *f.shape)
        scores = [rules.region_scores(a, own) for a in alphas]
        out = []
        for r in REGIONS:
            k = rules.champion(r, scores)
            out.append({"region": r, "candidate": f.row["names"][k], "score": scores[k][r] + 0.10 * scores[k]["overall"]})
        return {"of_": out}

    got = api.per_frame(d, rule, "of_ array<struct<region:string,candidate:string,score:double>>", *REGIONS, "names", "values").select(*KEYS, F.explode("of_").alias("x"))
    names = F.create_map(*[F.lit(x) for pair in VIEWED.items() for x in pair])
    return got.select(*KEYS, names[F.col("x.region")].alias("region"), "x.candidate", _six(F.col("x.score")).alias("score"))


_RANKED = gs.query(f"SELECT ch.clip, ch.frame_idx, ch.region, {_NAMED.format('win')} AS candidate, {gs.rnd('CASE win WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END')} AS score FROM ch JOIN rw USING (clip, frame_idx, region)",
                   **{k: v for k, v in _SELECT_STEPS.items() if k in ("rk", "rw", "c1", "c2", "ch")})


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a tracker: starts from the first frame's mask and follows the alphas."""
    def make():
        def rule(f: Frame, state):
            state = f["mask"].astype(float) if state is None else state
            state = 0.5 * state + 0.5 * f["a"]
            return state, state

        return rule

    d = api.per_frame(frames(spark, sf_dir), lambda f: {"mask": f["a"] >= 0.9}, "mask array<boolean>", "a", keep=tuple(frames(spark, sf_dir).columns))
    made, _ = models.generate(d, [models.Generator("sam2", make, ("a",), guidance="mask", recurrent=True)])
    return api.cells(made, "a").select(*KEYS, "y", "x", _six(F.col("a")).alias("alpha"))


_TRACKED = gs.query("SELECT clip, frame_idx, y, x, " + gs.rnd("s") + " AS alpha FROM r0", o="SELECT *, row_number() OVER (PARTITION BY clip, y, x ORDER BY frame_idx) AS n FROM px",
                    r0="SELECT clip, frame_idx, y, x, n, 0.5e0 * (CASE WHEN a >= 0.9e0 THEN 1e0 ELSE 0e0 END) + 0.5e0 * a AS s FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.frame_idx, o.y, o.x, o.n, 0.5e0 * r0.s + 0.5e0 * o.a FROM r0 JOIN o ON o.clip = r0.clip AND o.y = r0.y AND o.x = r0.x AND o.n = r0.n + 1")


def sequence_model(f: Frame) -> dict:
    """A sequence model's alpha with its swirls kept; where the model fails, one half everywhere."""
    try:
        if f["frame_idx"] % 4 == 0:
            raise RuntimeError("no frame came back")
        a = rules.swirl_kept(f.picture, models.checked({"alpha": f["ai"]}, f.shape))
    except RuntimeError:
        a = np.full(f.shape, 0.5)
    return {"alpha": a}


def _swirl_ai() -> str:
    s = "(b > g + 8 OR (r > g + 8 AND b > g + 4) OR (br > 150 AND ch < 70 AND g < 205))"
    return gs.query(gs.shown(f"(SELECT {gs.KEYS}, (CASE WHEN frame_idx % 4 = 0 THEN 0.5e0 WHEN {s} AND ai < 0.42e0 AND top / 255e0 > 0.45e0 THEN greatest(ai, least(0.55e0, top / 255e0 * 0.58e0)) ELSE ai END) AS v FROM px JOIN d USING ({gs.KEYS}))", alpha="v"),
                    u=f"SELECT {gs.KEYS}, floor(ai * 255e0) AS u8 FROM px", d=gs.near("u", gs.square(9), top="max(n.u8)"))


def prompted(f: Frame) -> dict:
    """A mask from point prompts: the best of a predictor's masks, cut at one half. The stand-in gives how like the first prompt's colour a cell is."""
    points, labels = [(2, 2), (5, 5)], [1, 0]
    p = f.picture
    like = lambda y, x: 1 - (np.abs(p.r - p.r[y, x]) + np.abs(p.g - p.g[y, x]) + np.abs(p.b - p.b[y, x])) / 765
    y, x = (min(points[0][0], f.shape[0] - 1), min(points[0][1], f.shape[1] - 1))
    masks = [like(y, x) * (1 if labels[0] else 0)]
    return {"mask": masks[0] > 0.5}


_PROMPTED = gs.query(f"SELECT px.clip, px.frame_idx, px.y, px.x, 1e0 - (abs(px.r - q.r) + abs(px.g - q.g) + abs(px.b - q.b)) / 765e0 > 0.5e0 AS mask FROM px JOIN px q ON q.clip = px.clip AND q.frame_idx = px.frame_idx AND q.y = 2 AND q.x = 2")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent model's alphas over the video's fixed background colour."""
    from alphaloom.operators.stages import fakes

    made, _ = models.generate(frames(spark, sf_dir), [g for g in fakes() if g.name == "rvm"])
    d = made.select(*KEYS, F.col("a").alias("m")).join(frames(spark, sf_dir), KEYS)
    over = {f"{c}_": _over(c, bg) for c, bg in zip(COLOURS, (120.0, 255.0, 155.0))}
    return api.cells(d.withColumns(over), "r_", "g_", "b_").select(*KEYS, "y", "x", *[_six(F.col(f"{c}_")).alias(n) for c, n in zip(COLOURS, ("red", "green", "blue"))])


def _over(channel: str, background: float):
    return F.zip_with(channel, "m", lambda v, a: v * a + background * (1 - a))


def _converted_sql() -> str:
    return gs.query("SELECT px.clip, px.frame_idx, px.y, px.x, " + ", ".join(f"{gs.rnd(f'px.{c} * s + {bg} * (1e0 - s)')} AS {n}" for c, bg, n in zip(COLOURS, ("120e0", "255e0", "155e0"), ("red", "green", "blue"))) + " FROM px JOIN r0 USING (clip, frame_idx, y, x)",
                    o="SELECT *, row_number() OVER (PARTITION BY clip, y, x ORDER BY frame_idx) AS n FROM px", r0="SELECT clip, frame_idx, y, x, n, a AS s FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.frame_idx, o.y, o.x, o.n, 0.5e0 * r0.s + 0.5e0 * o.a FROM r0 JOIN o ON o.clip = r0.clip AND o.y = r0.y AND o.x = r0.x AND o.n = r0.n + 1")


def semantic(f: Frame) -> dict:
    """The merge with a semantic subject, which only counts beside the model 'gvm', and without."""
    args = (f.picture, f["a"], f["ai"])
    return {"with_subject": rules.green_merged(*args, model="gvm", semantic=rules.clip(1 - f["ai"])), "without": rules.green_merged(*args, model="gvm")}


# --- texts


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, text): each clip's quality metrics as lines key=value."""
    q = api.quality(frames(spark, sf_dir))
    parts = [F.concat(F.lit("frame_count="), F.col("frames")), *[F.concat(F.lit(f"{k}="), F.format_string("%.6f", F.round(F.col(c) + 1e-9, 6))) for k, c in (("overall_score", "overall_score"), ("mean_edge_uncertainty", "edge"), ("background_residue", "residue"), ("temporal_flicker", "flicker"))],
             F.concat(F.lit("speckle_pixels="), F.col("speckles")), F.concat(F.lit("hole_pixels="), F.col("holes"))]
    return q.select("clip", F.concat_ws("\n", *parts).alias("text"))


_METRIC_LINES = ("SELECT clip, 'frame_count=' || frames || chr(10) || " + " || chr(10) || ".join(f"'{k}=' || printf('%.6f', {c})" for k, c in (("overall_score", "overall_score"), ("mean_edge_uncertainty", "edge"), ("background_residue", "residue"), ("temporal_flicker", "flicker")))
                 + f" || chr(10) || 'speckle_pixels=' || speckles || chr(10) || 'hole_pixels=' || holes AS text FROM ({AGGREGATES['a01'].sql()})")


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame_idx, ord, line): a line for each decision of the selection."""
    d = selection(spark, sf_dir).select(*KEYS, F.posexplode("decisions").alias("ord", "d"))
    return d.select(*KEYS, F.concat(F.lit("frame "), F.col("frame_idx"), F.lit(": "), F.col("d.region"), F.lit(" -> "), F.col("d.candidate"), F.lit(" ("), F.col("d.pixels"), F.lit(" px)")).alias("line"))


_LABEL = "CASE region " + " ".join(f"WHEN '{b}' THEN '{a}'" for a, b in VIEWED.items()) + " END"
_SHEET = gs.query(f"SELECT clip, frame_idx, 'frame ' || frame_idx || ': ' || {_LABEL} || ' -> ' || {_NAMED.format('k')} || ' (' || count(*) || ' px)' AS line FROM (SELECT clip, frame_idx, region, CASE WHEN reasons <> '' THEN safe ELSE win END AS k FROM pk JOIN fin USING (clip, frame_idx) WHERE region <> 'none') GROUP BY clip, frame_idx, region, k", **_SELECT_STEPS)

#: Artifacts by the setting that turns each on, and its folder.
ARTIFACTS = {"fg": "FG", "matte": "Matte", "comp": "Comp", "processed": "Processed", "mask": "Mask", "preview": "preview.mp4"}


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of the outputs that an order has turned on."""
    o = table("orders", "o_orderkey").frame(spark, sf_dir)
    on = F.map_from_arrays(F.array(*[F.lit(k) for k in ARTIFACTS]), F.array(*[(F.col("o_orderkey") % (k + 2) != 0) for k in range(len(ARTIFACTS))]))
    folder = F.create_map(*[F.lit(x) for pair in ARTIFACTS.items() for x in pair])
    kept = F.map_filter(on, lambda _, v: v)
    return o.select("o_orderkey", F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), folder[k])), ",").alias("artifacts"))


_ARTIFACTS = "SELECT o_orderkey, concat_ws(',', " + ", ".join(f"CASE WHEN o_orderkey % {list(ARTIFACTS).index(k) + 2} <> 0 THEN '{k}={ARTIFACTS[k]}' END" for k in sorted(ARTIFACTS)) + ") AS artifacts FROM orders"


# --- diagnoses


def focused(d: DataFrame) -> DataFrame:
    """Diagnosed frames with the fallback's flags, what to look at first, and why."""
    delta = lambda a, b: F.col(a) - F.col(b)
    d = d.withColumns({"entity_delta": delta("entity_new_mean", "entity_model_mean"), "effect_delta": delta("effect_new_mean", "effect_model_mean"), "transition_delta": delta("transition_new_mean", "transition_model_mean"), "selected_delta": delta("new_mean", "model_mean")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = d.withColumn("weighted", 0.65 * zero("entity_delta") + 0.20 * zero("transition_delta") + 0.15 * zero("effect_delta"))
    damage = zero("effect_delta") < -0.03
    weak = ~damage & (F.col("weighted") < 0.02)
    say = lambda label, c, text: F.concat(F.lit(f"{label}="), F.format_string("%.3f", F.col(c)), F.lit(f" {text}"))
    gain = (F.col("entity_delta") >= 0.05) | (F.col("selected_delta") >= 0.03)
    focus = F.when(damage, "effect_damage_hotspot").when(weak, "subject_recovery_gap").when(F.col("effect_delta") <= -0.03, "transparent_effect_instability_hotspot").when(gain, "subject_recovery_gain_hotspot").otherwise("general_merge_delta_hotspot")
    d = d.withColumn("focus", focus)
    reason = (F.when(F.col("focus") == "effect_damage_hotspot", say("fallback_effect_delta", "effect_delta", "suggests fallback would damage transparent effect regions"))
              .when((F.col("focus") == "subject_recovery_gap") & F.col("entity_delta").isNotNull(), say("fallback_entity_delta", "entity_delta", "suggests fallback misses subject backbone recovery"))
              .when(F.col("focus") == "subject_recovery_gap", say("fallback_weighted_score", "weighted", "suggests fallback subject recovery remains too weak"))
              .when((F.col("focus") == "subject_recovery_gain_hotspot") & F.col("entity_delta").isNotNull(), say("entity_selected_vs_gvm_mean_delta", "entity_delta", "suggests stronger subject recovery than baseline gvm"))
              .when(F.col("focus") == "subject_recovery_gain_hotspot", say("selected_vs_gvm_mean_delta", "selected_delta", "suggests stronger subject recovery than baseline gvm"))
              .when(F.col("focus") == "transparent_effect_instability_hotspot", say("effect_selected_vs_gvm_mean_delta", "effect_delta", "suggests transparent effect instability")))
    return d.withColumn("reason", reason).withColumn("damage", damage).withColumn("weak", weak)


def input_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an input: its frames' focuses counted, the commonest (first seen among equals), means without nulls, the dominant risk of its largest changes and a conclusion."""
    d = focused(diagnosed(spark, sf_dir))
    counts = d.groupBy("clip", "focus").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_seen"))
    top = counts.groupBy("clip").agg(F.max_by("focus", F.struct("n", (-F.col("first_seen")).alias("k"))).alias("dominant_focus"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("focus", "n")))).alias("focus_counts"))
    ranked_ = d.where("effect_risk is not null").groupBy("clip").agg(F.max_by("effect_risk", F.struct("crop_peak", (-F.col("frame_idx")).alias("k"))).alias("dominant_risk"))
    sums = d.groupBy("clip").agg(F.count(F.lit(1)).alias("samples"), F.count_if("damage").alias("damage_blocked"), F.count_if("weak").alias("score_blocked"), _six(F.avg("selected_delta")).alias("mean_delta"), _six(F.avg("weighted")).alias("mean_weighted"))
    out = sums.join(top, "clip").join(ranked_, "clip", "left")
    return out.withColumn("conclusion", F.when(F.col("damage_blocked") * 2 > F.col("samples"), "effect damage").when(F.col("score_blocked") * 2 > F.col("samples"), "weak subject recovery").when(F.col("dominant_risk").isNotNull(), "effect risk").otherwise("accepted")).withColumn("focus_counts", F.to_json("focus_counts"))


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested parameters for each asset: none for what isn't an image, else by the frame that stands for it."""
    a = assets(spark, sf_dir)
    auto = AUTO.frame(spark, sf_dir)
    is_image = manifests.suffix(F.col("path")).isin(*manifests.IMAGE)
    d = a.withColumn("frame_idx", (F.col("p_partkey") % 100).cast("long")).join(auto, "frame_idx", "left")
    purity = F.greatest("green_excess", "blue_excess")
    screen = F.when(F.col("blue_excess") > F.col("green_excess") * 1.15, "blue").otherwise("green")
    similar = F.when(purity > 0.22, 0.35).when(purity < 0.10, 0.55).otherwise(0.4)
    key = F.when(F.col("white_subject") > 0.08, 0.95).otherwise(1.0)
    keep = F.when((F.col("pink_glow") > 0.05) | (F.col("white_glow") > 0.08), 0.72).otherwise(0.7)
    text = F.concat(F.lit("自动优化: sample=image, screen="), screen, F.lit(", similarity="), F.format_string("%.2f", similar), F.lit(", key="), F.format_string("%.2f", key), F.lit(", preserve="), F.format_string("%.2f", keep))
    return d.select("p_partkey", F.when(is_image & F.col("clip").isNotNull(), F.when(F.col("white_subject") > 0.08, 170).otherwise(180)).alias("white_brightness"),
                    F.when(~is_image, "自动优化跳过: 当前仅支持单帧图片").when(F.col("clip").isNull(), "自动优化跳过: 图片为空").otherwise(text).alias("summary"))


def _suggested_sql() -> str:
    from alphaloom.operators.gates import _ASSETS

    image = "lower(ending) IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tif', '.tiff', '.exr')"
    pure = "greatest(green_excess, blue_excess)"
    text = (f"'自动优化: sample=image, screen=' || (CASE WHEN blue_excess > green_excess * 1.15 THEN 'blue' ELSE 'green' END) || ', similarity=' || (CASE WHEN {pure} > 0.22 THEN '0.35' WHEN {pure} < 0.1 THEN '0.55' ELSE '0.40' END) || ', key=' || (CASE WHEN white_subject > 0.08 THEN '0.95' ELSE '1.00' END) "
            "|| ', preserve=' || (CASE WHEN pink_glow > 0.05 OR white_glow > 0.08 THEN '0.72' ELSE '0.70' END)")
    return f"WITH {_ASSETS} SELECT p_partkey, CASE WHEN {image} AND clip IS NOT NULL THEN (CASE WHEN white_subject > 0.08 THEN 170 ELSE 180 END)::INT END AS white_brightness, CASE WHEN NOT {image} THEN '自动优化跳过: 当前仅支持单帧图片' WHEN clip IS NULL THEN '自动优化跳过: 图片为空' ELSE {text} END AS summary FROM p LEFT JOIN ({AUTO.sql()}) t ON t.frame_idx = p.p_partkey % 100"


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle frame of each clip, that stands for it."""
    d = api.numbered(frames(spark, sf_dir).select(*KEYS)).withColumn("of_", F.count(F.lit(1)).over(Window.partitionBy("clip")))
    return d.where(F.col("n") - 1 == F.floor(F.col("of_") / 2)).select(*KEYS)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, stage, current, total): how far a run of stages has come, as events of (current, total, stage) that grow to 100."""
    stages = [("decoding", 0), ("matting", 10), ("refining", 50), ("despeckling", 55), ("stabilizing", 60), ("decontaminating", 75), ("encoding", 85), ("completed", 100)]
    n = frames(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    told = F.array(*[F.struct(F.lit(p).alias("current"), F.lit(s).alias("stage")) for s, p in stages])
    d = n.select("clip", "n", F.explode(told).alias("e")).where((F.col("e.stage") != "stabilizing") | (F.col("n") > 1))
    return d.select("clip", F.col("e.stage").alias("stage"), F.col("e.current").cast("int").alias("current"), F.lit(100).alias("total"))


OPS: dict[str, Relation] = {
    "r01_region_rank": query(ranked, _RANKED),
    "w07_mask_tracking": query(tracked, _TRACKED),
    "u07_matanyone2_candidate": query(tracked, _TRACKED),
    "u08_sam2_candidate": query(tracked, _TRACKED),
    "u26_gvm_sequence": pixels(sequence_model, ("ai", *COLOURS), _swirl_ai(), None, alpha="double"),
    "u29_segmentation_prompt": pixels(prompted, COLOURS, _PROMPTED, None, mask="boolean"),
    "u30_convert_video": query(converted, _converted_sql()),
    "u22_semantic_subject": pixels(semantic, BOTH, None, None, with_subject="double", without="double"),
    "k08_quality_debug_txt": query(metric_lines, _METRIC_LINES),
    "k09_selection_debug_sheet": query(sheet, _SHEET),
    "k13_artifact_manifest": query(artifacts, _ARTIFACTS),
    "x14_focus_rules": query(lambda s, d: focused(diagnosed(s, d)).select(*KEYS, "focus", "reason"), None),
    "u28_diag_runner": query(input_summary, None),
    "x33_single_frame_params": query(suggested, _suggested_sql()),
    "s15_representative_frame": query(representative, f"SELECT clip, frame_idx FROM (SELECT clip, frame_idx, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM (SELECT DISTINCT clip, frame_idx FROM ({PIXELS.sql()}))) WHERE i = n // 2"),
    "s17_asset_scan": query(lambda s, d: images.asset_files(s, d, (".parquet",)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), (F.col("size") > 0).alias("has_content")), None),
    "w15_progress_events": query(progress, f"SELECT clip, stage, current::INT AS current, 100::INT AS total FROM (SELECT clip, count(DISTINCT frame_idx) AS n FROM ({PIXELS.sql()}) GROUP BY clip), (VALUES ('decoding', 0), ('matting', 10), ('refining', 50), ('despeckling', 55), ('stabilizing', 60), ('decontaminating', 75), ('encoding', 85), ('completed', 100)) AS e(stage, current) WHERE stage <> 'stabilizing' OR n > 1"),
}

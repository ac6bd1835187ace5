"""Queries of reports, manifests and diagnoses: real JSON texts are made of the test data's tables, read, flattened and gated.

The SQL beside each query computes the same from the tables themselves, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators.framed import query
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import BASELINE, METRICS, PIXELS
from alphaloom.reports import diagnostics, manifests, regression

#: Report metrics by what the view calls them.
NAMES = {"overall_score": "overall_score", "mean_edge_uncertainty": "edge", "hole_pixels": "holes", "background_residue": "residue", "temporal_flicker": "flicker",
         "edge_temporal_flicker": "edge_flicker", "transparent_temporal_flicker": "transparent_flicker", "max_frame_delta": "frame_delta"}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): a report for each sample; of every ten one is no JSON and one no object, and one has neither risks nor a job."""
    m = METRICS.frame(spark, sf_dir)
    six = lambda k: regression.fixed(F.col(k), 12)
    quality = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{a}": '), F.col(b).cast("string") if b == "holes" else six(b)) for a, b in NAMES.items()]), F.lit(', "speckle_pixels": null}'))
    level = F.when(F.col("hair_risk") >= 0.7, "fail").when(F.col("hair_risk") >= 0.35, "warn").otherwise("pass")
    risks = F.concat(F.lit('{"hair_edge_loss": {"score": '), six("hair_risk"), F.lit(', "level": "'), level, F.lit('", "signals": {"hair_low_alpha_ratio": '), six("hair_low"), F.lit(', "note": "text", "flag": true}}, '
                     '"transparent_effect_loss": {"score": "0.25", "signals": {"effect_low_alpha_ratio": '), six("effect_low"), F.lit('}}, "odd": 3}'))
    job = F.concat(F.lit('{"input_path": "/in/'), F.col("sample"), F.lit('.mp4", "frame_count": 3}'))
    whole = F.concat(F.lit('{"schema_version": 2, "job": '), job, F.lit(', "quality": '), quality, F.lit(', "p0_risks": '), risks, F.lit(', "quality_selection": {"available": true, "candidate_count": '), (F.col("k") % 3).cast("string"), F.lit("}}"))
    bare = F.concat(F.lit('{"quality": '), quality, F.lit("}"))
    raw = F.when(F.col("k") % 10 == 1, F.concat(F.lit("{"), whole)).when(F.col("k") % 10 == 2, F.concat(F.lit("["), whole, F.lit("]"))).when(F.col("k") % 10 == 3, bare).otherwise(whole)
    return m.select(F.concat(F.lit("/runs/"), F.col("sample"), F.lit("/processing_report.json")).alias("path"), raw.alias("raw"))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw): one baseline document a sample that has one, half of them under 'samples'; texts, flags and odd samples in it don't count."""
    b = BASELINE.frame(spark, sf_dir)
    six = lambda k: regression.fixed(F.col(k), 12)
    one = F.concat(F.lit('{"'), F.col("sample"), F.lit('": {"overall_score": '), six("base_score"), F.lit(', "p0_risk.hair_edge_loss.score": '), six("base_hair"), F.lit(', "note": "x", "flag": true}, "odd": [1]}'))
    return b.select(F.when(F.length("sample") % 2 == 0, F.concat(F.lit('{"samples": '), one, F.lit("}"))).otherwise(one).alias("raw"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.evaluate(reports(spark, sf_dir), regression.baseline(baselines(spark, sf_dir)))


_SIX = lambda x: f"printf('%.12f', {x})::DOUBLE"
#: Steps: m (metrics as the reports hold them; zeros where a report can't be read), f (their failures).
_M = "m AS (SELECT sample, '/runs/' || sample || '/processing_report.json' AS path, k % 10 AS kind, k % 3 AS cands, " + ", ".join(
    (f"CASE WHEN k % 10 IN (1, 2) THEN 0 ELSE {b} END AS {a}" if b == "holes" else f"CASE WHEN k % 10 IN (1, 2) THEN 0e0 ELSE {_SIX(b)} END AS {a}") for a, b in NAMES.items()) + (
    f", CASE WHEN k % 10 IN (1, 2, 3) THEN 0e0 ELSE {_SIX('hair_low')} END AS hair_low, CASE WHEN k % 10 IN (1, 2, 3) THEN 0e0 ELSE {_SIX('effect_low')} END AS effect_low, CASE WHEN k % 10 IN (1, 2, 3) THEN NULL ELSE {_SIX('hair_risk')} END AS hair_risk, hair_risk AS raw_risk FROM ({METRICS.sql()}))")
_B = f"b AS (SELECT sample, {_SIX('base_score')} AS base_score, {_SIX('base_hair')} AS base_hair FROM ({BASELINE.sql()}))"


def _over(metric: str, name: str, limit: float) -> str:
    return f"CASE WHEN {metric} > {limit} THEN '{name} ' || printf('%.3f', {metric}) || ' above maximum {limit:.3f}' END"


_CHECKS = [
    "CASE WHEN overall_score < 0.8 THEN 'overall_score ' || printf('%.3f', overall_score) || ' below minimum 0.800' END", _over("mean_edge_uncertainty", "mean_edge_uncertainty", 0.08),
    "CASE WHEN hole_pixels > 100 THEN 'hole_pixels ' || hole_pixels || ' above maximum 100' END", _over("background_residue", "background_residue", 0.02), _over("temporal_flicker", "temporal_flicker", 0.08),
    _over("edge_temporal_flicker", "edge_temporal_flicker", 0.08), _over("transparent_temporal_flicker", "transparent_temporal_flicker", 0.08), _over("max_frame_delta", "max_frame_delta", 0.12), _over("hair_low", "hair_low_alpha_ratio", 0.3), _over("effect_low", "effect_low_alpha_ratio", 0.3),
    "CASE WHEN kind <> 3 AND cands = 0 THEN 'quality selection enabled but no candidates available' END",
    "CASE WHEN base_score - overall_score > 0.05 THEN 'overall_score dropped ' || printf('%.3f', base_score - overall_score) || ' from baseline ' || printf('%.3f', base_score) END",
    "CASE WHEN hair_risk IS NOT NULL AND raw_risk >= 0.7 THEN 'p0 hair_edge_loss level fail' END",
    "CASE WHEN hair_risk - base_hair > 0.2 THEN 'p0 hair_edge_loss risk increased ' || printf('%.3f', hair_risk - base_hair) || ' from baseline ' || printf('%.3f', base_hair) END"]
_F = ("f AS (SELECT m.*, base_score, base_hair, CASE kind WHEN 1 THEN 'invalid processing report: malformed JSON' WHEN 2 THEN 'invalid processing report: top-level JSON must be an object' ELSE concat_ws('; ', " + ", ".join(_CHECKS) + ") END AS failures, "
      "CASE WHEN kind IN (1, 2) THEN sample ELSE sample END AS named FROM m LEFT JOIN b USING (sample))")
_WITH = f"WITH {_M}, {_B}, {_F} "


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir)
    return d.select("sample", F.when(F.col("passed"), "pass").otherwise("fail").alias("status"), F.array_join("failures", "; ").alias("failures"), (F.round(F.col("overall_score") + 1e-9, 6) + 0.0).alias("score"))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir)
    level = F.col("risk_levels")["p0_risk.hair_edge_loss.level"]
    return d.select("sample", level.alias("level"), F.array_join(F.filter("failures", lambda x: x.startswith("p0 ")), "; ").alias("failures"))


def failing_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root below which there is no report, beside one with reports."""
    every = reports(spark, sf_dir)
    none = regression.evaluate(regression.discover(every, "/nowhere").select("path", "raw"), root="/nowhere").select(F.lit("/nowhere").alias("root"), "path", F.array_join("failures", "; ").alias("failures"))
    some = regression.evaluate(regression.discover(every, "/runs/supplier_11").select("path", "raw"), root="/runs/supplier_11").select(F.lit("/runs/supplier_11").alias("root"), "path", F.array_join(F.slice("failures", 1, 0), "; ").alias("failures"))
    return none.unionByName(some)


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, raw): a manifest for each nation, a sample for each of its suppliers; every second sample leaves what has a default."""
    s = table("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").frame(spark, sf_dir)
    full = F.concat(F.lit(', "quality_mode": "high", "candidate_models": ["gvm", "rvm"], "risk_ceilings": {"hair_edge_loss": '), F.format_string("%.2f", F.abs("s_acctbal") / 10000), F.lit('}, "alpha_mae_ceiling": 0.25'))
    one = F.concat(F.lit('{"name": "'), F.col("s_name"), F.lit('", "input_path": "assets/'), F.col("s_name"), F.lit('.mp4", "background_mode": "auto"'), F.when(F.col("s_suppkey") % 2 == 0, full).otherwise(""), F.lit("}"))
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.concat(F.lit('{"samples": ['), F.array_join(F.array_sort(F.collect_list(one)), ", "), F.lit("]}")).alias("raw"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = manifests.samples(manifest_texts(spark, sf_dir))
    return d.select("nation", "name", "input_path", "background_mode", "quality_mode", F.array_join("candidate_models", ",").alias("models"), F.col("risk_ceilings")["hair_edge_loss"].alias("hair_ceiling"), "alpha_mae_ceiling", F.size("required_temporal_models").alias("n_required"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of made-up assets, in folders and with names that tell modes or not."""
    k = F.col("p_partkey")
    folder = F.when(k % 4 == 0, "assets").when(k % 4 == 1, F.concat(F.lit("assets/Green_"), F.col("p_type"))).when(k % 4 == 2, F.concat(F.lit("assets/"), F.col("p_type"), F.lit("/blackroom"))).otherwise(F.concat(F.lit("assets/"), F.col("p_type")))
    end = F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".png", ".Exr", ".txt", "", ".webm", ".JPG")]), (k % 7 + 1).cast("int"))
    return table("part", "p_partkey", "p_name", "p_type").frame(spark, sf_dir).select("p_partkey", F.concat(folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), k.cast("string"), end).alias("path"))


_ASSETS = ("a AS (SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 'assets' WHEN 1 THEN 'assets/Green_' || p_type WHEN 2 THEN 'assets/' || p_type || '/blackroom' ELSE 'assets/' || p_type END) AS folder, replace(p_name, ' ', '-') || '.' || p_partkey AS base, "
           "['.MP4', '.png', '.Exr', '.txt', '', '.webm', '.JPG'][p_partkey % 7 + 1] AS ending FROM part), p AS (SELECT *, folder || '/' || base || ending AS path, CASE WHEN p_partkey % 4 = 2 THEN 'black_background' WHEN p_partkey % 4 = 1 THEN 'green_screen' ELSE 'auto' END AS mode, "
           "CASE WHEN folder = 'assets' THEN '' ELSE lower(regexp_extract(folder, '[^/]+$')) || '_' END || lower(CASE WHEN ending = '' THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END) AS name FROM a)")


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = manifests.generated(assets(spark, sf_dir))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("risk_ceilings")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ",")
    return d.select("name", "input_path", "background_mode", "quality_mode", F.array_join("candidate_models", ",").alias("models"), told.alias("ceilings"))


_CEILINGS = "CASE mode WHEN 'black_background' THEN 'background_residue=0.20,transparent_effect_loss=0.50' WHEN 'green_screen' THEN 'background_residue=0.20,hair_edge_loss=0.50' ELSE 'background_residue=0.25,hair_edge_loss=0.60' END"

#: Error messages as they come, one for each event.
MESSAGES = ["Input not found: /in/a.mp4", "CUDA out of memory. Tried to allocate 2 GiB", "Permission denied: '/out'", "cannot read FIRST frame of clip", "division by zero", "Unsupported image format: .gif", "callback broke", "OutOfMemoryError", "read-only file system", "no such key", "", "Access is denied | input not found"]
KINDS = ["ValueError", "RuntimeError", "PermissionError", "ValueError", "ZeroDivisionError", "ValueError", "ProgressCallbackError", "RuntimeError", "OSError", "KeyError", "FileNotFoundError", "OSError"]
CODES = ["INPUT_INVALID", "GPU_OUT_OF_MEMORY", "OUTPUT_DIR_UNWRITABLE", "INPUT_INVALID", "UNKNOWN_PROCESSING_ERROR", "INPUT_INVALID", "PROGRESS_CALLBACK_FAILED", "GPU_OUT_OF_MEMORY", "OUTPUT_DIR_UNWRITABLE", "UNKNOWN_PROCESSING_ERROR", "INPUT_INVALID", "INPUT_INVALID"]
MODELS = [("gvm", "GVM", False, "runtime 不可导入: torch", False), ("sam2", "SAM2", False, "仅支持 CUDA", False), ("rvm", "RVM", True, None, True), ("birefnet", "BiRefNet", False, "缺少文件", True), ("rembg", None, False, None, None)]


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, kind, messages): an error for each event, wrapped in another for every third."""
    e = table("events", "event_id", "user_id").frame(spark, sf_dir)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    chain = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("job "), F.col("event_id"), F.lit(" failed")), pick(MESSAGES))).otherwise(F.array(pick(MESSAGES)))
    return e.select("event_id", "user_id", pick(KINDS).alias("kind"), chain.alias("messages"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(spark, sf_dir).withColumn("code", diagnostics.exception_code(F.col("kind"), F.col("messages")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every user: those of errors, and those of the models for each event that asked for one."""
    d = coded(spark, sf_dir)
    code = F.col("code")
    own = d.select("user_id", "event_id", "code", F.lit("error").alias("severity"), diagnostics.text_of(code, 0).alias("title"), diagnostics.text_of(code, 1).alias("summary"), diagnostics.text_of(code, 2).alias("actions"), F.lit(True).alias("blocking"))
    asked = d.where("event_id % 2 = 0").select("user_id", "event_id", F.element_at(F.array(*[F.lit(m[0]) for m in MODELS]), (F.col("event_id") % 5 + 1).cast("int")).alias("model_key"))
    known = spark.createDataFrame(MODELS, "model_key string, display_name string, available boolean, reason string, auto_download boolean")
    return own.unionByName(diagnostics.model_items(asked.join(known, "model_key")).select(own.columns))


_CASE = lambda values, of: "CASE " + of + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
_CODE = _CASE(CODES, "event_id % 12")



def _user_text_sql() -> str:
    said = lambda code: f"[error] {diagnostics.TEXTS[code][0]}: {diagnostics.TEXTS[code][1]}"
    own = "SELECT user_id, event_id, " + _CODE + " AS key, " + _CASE([said(c) for c in CODES], "event_id % 12") + " AS said, " + "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {1 + len(diagnostics.TEXTS[c][2])}" for k, c in enumerate(CODES)) + " END AS n FROM events"
    models = {0: "[error] GVM runtime 不可用: GVM 已安装，但运行时依赖无法导入。", 1: "[error] SAM2 需要 CUDA: SAM2 仅支持 CUDA GPU。", 3: "[warning] BiRefNet 不可用: BiRefNet 当前不可用，通常是模型文件缺失。", 4: "[error] rembg 不可用: rembg 当前不可用，通常是模型文件缺失。"}
    asked = "SELECT user_id, event_id, 'model ' || event_id % 5, CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in models.items()) + " END, 3 FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 2"
    return f"WITH i AS ({own} UNION ALL {asked}), d AS (SELECT user_id, key, said, n, min(event_id) AS event_id FROM i GROUP BY user_id, key, said, n) SELECT user_id, sum(n)::INT AS lines, first(said ORDER BY event_id, said) AS first_line FROM d GROUP BY user_id"


_COUNTS = "SELECT clip, count(*) AS cells, count(DISTINCT frame_idx) AS frames, " + ", ".join(f"count(CASE WHEN {b} THEN 1 END) AS {a}" for a, b in (("subject", "subject"), ("hair_edge", "hair"), ("luminous_prop", "luminous"), ("transparent_effect", "transparent"), ("background_residue", "residue"), ("uncertain_edge", "uncertain")))


def supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.operators.framed import owned
    from alphaloom.frames import api

    d = owned(spark, sf_dir)
    count = ", ".join(f"{r} long" for r in manifests.REGIONS)
    each = api.per_frame(d, lambda f: {r: int(f[r].sum()) for r in manifests.REGIONS}, count, *manifests.REGIONS)
    total = each.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("height") * F.col("width")).alias("cells"), *[F.sum(r).alias(r) for r in manifests.REGIONS])
    wanted = spark.createDataFrame([(str(k), [manifests.REGIONS[k % 6], "subject"], {"subject": 0.5 + k / 100, "hair_edge": 0.3}) for k in range(0, 10, 2)], "c string, required array<string>, min_ratios map<string,double>")
    told = manifests.expectation_failures(total, wanted.withColumn("clip", F.col("c").cast(d.schema["clip"].dataType)).drop("c"))
    return told.select("clip", "frames", "cells", *[(F.round(F.col(r) / F.col("cells") + 1e-9, 6) + 0.0).alias(f"{r}_ratio") for r in manifests.REGIONS], F.array_join("failures", "; ").alias("failures"))


def _supervision_sql() -> str:
    from alphaloom.plans.views import MASKS

    ratio = lambda r: f"round({r} / cells + 1e-9, 6) + 0e0"
    region = "CASE clip::INT % 6 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(manifests.REGIONS)) + " END"
    have = "CASE clip::INT % 6 " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(manifests.REGIONS)) + " END"
    low = lambda r, m: f"CASE WHEN round({r} / cells, 6) < {m} THEN 'region_ratio {r} ' || printf('%.6f', round({r} / cells, 6)) || ' below minimum ' || printf('%.6f', {m}) END"
    fails = f"CASE WHEN clip::INT % 2 = 0 THEN concat_ws('; ', CASE WHEN {have} <= 0 THEN 'required_region ' || {region} || ' missing' END, CASE WHEN subject <= 0 THEN 'required_region subject missing' END, {low('hair_edge', '0.3e0')}, {low('subject', '(0.5e0 + clip::INT / 100e0)')}) ELSE '' END"
    return f"WITH c AS ({_COUNTS} FROM ({MASKS.sql()}) GROUP BY clip) SELECT clip, frames, cells, {', '.join(f'{ratio(r)} AS {r}_ratio' for r in manifests.REGIONS)}, {fails} AS failures FROM c"


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each clip, an error if there are more than the limit."""
    from alphaloom.operators.framed import frames
    from alphaloom.sources.images import frame_limit

    return frame_limit(frames(spark, sf_dir).select("clip", "frame_idx"), 1800).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))


OPS: dict[str, Relation] = {
    "s06_frame_limit": query(limited, f"SELECT clip, count(DISTINCT frame_idx) AS frames FROM ({PIXELS.sql()}) GROUP BY clip"),
    "s08_report_discovery": query(lambda s, d: regression.discover(assets(s, d).select(F.concat(F.lit("/reports/"), F.col("path"), F.when(F.col("p_partkey") % 3 == 0, "/processing_report.json").when(F.col("p_partkey") % 3 == 1, "/old_processing_report.json").otherwise("")).alias("path")), "/reports/assets/"),
                                  f"WITH {_ASSETS} SELECT '/reports/' || path || '/processing_report.json' AS path FROM p WHERE p_partkey % 3 = 0"),
    "s09_report_json_scan": query(lambda s, d: regression.parsed(reports(s, d)).select("path", "sample", F.coalesce("failure", F.lit("")).alias("failure"), F.expr("try_variant_get(report, '$.job.frame_count', 'bigint')").alias("frame_count")),
                                  _WITH + "SELECT path, sample, CASE kind WHEN 1 THEN 'invalid processing report: malformed JSON' WHEN 2 THEN 'invalid processing report: top-level JSON must be an object' ELSE '' END AS failure, CASE WHEN kind IN (1, 2, 3) THEN NULL ELSE 3::BIGINT END AS frame_count FROM f"),
    "s10_empty_root_guard": query(failing_root, _WITH + "SELECT '/nowhere' AS root, '/nowhere/processing_report.json' AS path, 'no processing_report.json files found' AS failures UNION ALL SELECT '/runs/supplier_11', path, '' FROM f WHERE sample = 'supplier_11' "
                                  "UNION ALL SELECT '/runs/supplier_11', '/runs/supplier_11/processing_report.json', '' WHERE NOT EXISTS (SELECT 1 FROM f WHERE sample = 'supplier_11')"),
    "s11_manifest_scan": query(manifest, "SELECT s_nationkey AS nation, s_name AS name, 'assets/' || s_name || '.mp4' AS input_path, 'auto' AS background_mode, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'standard' END AS quality_mode, CASE WHEN s_suppkey % 2 = 0 THEN 'gvm,rvm' ELSE '' END AS models, "
                               "CASE WHEN s_suppkey % 2 = 0 THEN printf('%.2f', abs(s_acctbal) / 10000)::DOUBLE END AS hair_ceiling, CASE WHEN s_suppkey % 2 = 0 THEN 0.25::DOUBLE END AS alpha_mae_ceiling, 0::INT AS n_required FROM supplier"),
    "s12_baseline_scan": query(lambda s, d: regression.baseline(baselines(s, d)), f"WITH {_B} SELECT sample, 'overall_score' AS metric, base_score AS value FROM b UNION ALL SELECT sample, 'p0_risk.hair_edge_loss.score', base_hair FROM b"),
    "x02_flatten_metrics": query(lambda s, d: regression.metric_rows(run(s, d)).select("sample", "metric", "value"),
                                 _WITH + " UNION ALL ".join([f"SELECT sample, '{k}' AS metric, {k}::DOUBLE AS value FROM f" for k in NAMES] + ["SELECT sample, 'speckle_pixels', 0e0 FROM f", "SELECT sample, 'p0_risk.hair_edge_loss.score', hair_risk FROM f WHERE hair_risk IS NOT NULL",
                                     "SELECT sample, 'p0_risk.transparent_effect_loss.score', 0.25e0 FROM f WHERE hair_risk IS NOT NULL", "SELECT sample, 'p0_risk.hair_edge_loss.signal.hair_low_alpha_ratio', hair_low FROM f WHERE hair_risk IS NOT NULL", "SELECT sample, 'p0_risk.transparent_effect_loss.signal.effect_low_alpha_ratio', effect_low FROM f WHERE hair_risk IS NOT NULL"])),
    "x03_threshold_gate": query(gate, _WITH + "SELECT sample, CASE WHEN failures = '' THEN 'pass' ELSE 'fail' END AS status, failures, round(overall_score + 1e-9, 6) + 0e0 AS score FROM f"),
    "x04_p0_gate": query(risks, _WITH + f"SELECT sample, CASE WHEN hair_risk IS NULL THEN NULL WHEN raw_risk >= 0.7 THEN 'fail' WHEN raw_risk >= 0.35 THEN 'warn' ELSE 'pass' END AS level, CASE WHEN kind IN (1, 2) THEN '' ELSE concat_ws('; ', {_CHECKS[-2]}, {_CHECKS[-1]}) END AS failures FROM f"),
    "x05_sample_name": query(lambda s, d: assets(s, d).select("p_partkey", regression.sample_name(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("path"), F.lit("/processing_report.json"))).otherwise(F.concat(F.col("path"), F.lit("/other.json"))), F.when(F.col("p_partkey") % 3 == 0, F.col("path"))).alias("name")),
                             f"WITH {_ASSETS} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (CASE WHEN ending = '' THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END) WHEN p_partkey % 2 = 0 THEN base || ending ELSE 'other' END AS name FROM p"),
    "x36_sample_result_row": query(lambda s, d: regression.sample_rows(run(s, d)).select("sample", "path", "status", F.get_json_object("document", "$.metrics.hole_pixels").cast("long").alias("holes"), F.expr("json_array_length(get_json_object(document, '$.failures'))").cast("long").alias("n_failures")),
                                   _WITH + "SELECT sample, path, CASE WHEN failures = '' THEN 'pass' ELSE 'fail' END AS status, hole_pixels::BIGINT AS holes, (CASE WHEN failures = '' THEN 0 ELSE len(string_split(failures, '; ')) END)::BIGINT AS n_failures FROM f"),
    "a35_regression_totals": query(lambda s, d: regression.summary(run(s, d)).select("total", "failed", F.col("status").alias("outcome")), _WITH + "SELECT count(*) AS total, count(CASE WHEN failures <> '' THEN 1 END) AS failed, CASE WHEN count(CASE WHEN failures <> '' THEN 1 END) = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM f"),
    "k05_regression_json": query(lambda s, d: regression.document(run(s, d)).select(F.get_json_object("document", "$.summary.failed_count").cast("long").alias("failed"), F.get_json_object("document", "$.thresholds.max_score_drop").alias("drop"), F.expr("json_array_length(get_json_object(document, '$.samples'))").cast("long").alias("samples"), F.get_json_object("document", "$.samples[0].sample_name").alias("first_sample")),
                                 _WITH + "SELECT count(CASE WHEN failures <> '' THEN 1 END) AS failed, '0.05' AS \"drop\", count(*) AS samples, arg_min(sample, path) AS first_sample FROM f"),
    "k06_regression_markdown": query(lambda s, d: regression.markdown(run(s, d)), _WITH + "SELECT '# Quality Regression Report' || chr(10) || chr(10) || 'Status: ' || (CASE WHEN count(CASE WHEN failures <> '' THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END) || chr(10) || 'Samples: ' || count(*) || chr(10) || 'Passed: ' || count(CASE WHEN failures = '' THEN 1 END) || chr(10) || 'Failed: ' || count(CASE WHEN failures <> '' THEN 1 END) || chr(10) || chr(10) || "
                                     "'| Sample | Status | Overall | Holes | Failures |' || chr(10) || '| --- | --- | ---: | ---: | --- |' || chr(10) || string_agg('| ' || sample || ' | ' || (CASE WHEN failures = '' THEN 'PASS' ELSE 'FAIL' END) || ' | ' || printf('%.3f', overall_score) || ' | ' || hole_pixels || ' | ' || replace(failures, '; ', '<br>') || ' |', chr(10) ORDER BY path) || chr(10) AS document FROM f"),
    "k07_quality_summary_write": query(lambda s, d: run(s, d).groupBy("passed").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("overall_score") + 1e-9, 6) + 0.0).alias("mean_score")).withColumnRenamed("passed", "completed"), _WITH + "SELECT failures = '' AS completed, count(*) AS n, round(avg(overall_score) + 1e-9, 6) + 0e0 AS mean_score FROM f GROUP BY 1"),
    "x08_classify_background_tokens": query(lambda s, d: assets(s, d).select("path", manifests.background_of(F.col("path")).alias("mode"), F.map_keys(manifests.ceilings(manifests.background_of(F.col("path"))))[1].alias("second_risk")), f"WITH {_ASSETS} SELECT path, mode, CASE mode WHEN 'black_background' THEN 'transparent_effect_loss' ELSE 'hair_edge_loss' END AS second_risk FROM p"),
    "x09_manifest_name": query(lambda s, d: assets(s, d).select("path", manifests.name_of(F.col("path")).alias("name")), f"WITH {_ASSETS} SELECT path, name FROM p"),
    "x34_manifest_build_sample": query(built, f"WITH {_ASSETS} SELECT name, path AS input_path, mode AS background_mode, 'standard' AS quality_mode, 'traditional' AS models, {_CEILINGS} AS ceilings FROM p WHERE ending NOT IN ('.txt', '') "),
    "k14_manifest_write": query(lambda s, d: manifests.generated(assets(s, d)).orderBy("input_path").select("input_path", F.to_json(F.struct("name", "input_path", "background_mode", "quality_mode", "candidate_models")).alias("entry")),
                                f"WITH {_ASSETS} SELECT path AS input_path, '{{\"name\":\"' || name || '\",\"input_path\":\"' || path || '\",\"background_mode\":\"' || mode || '\",\"quality_mode\":\"standard\",\"candidate_models\":[\"traditional\"]}}' AS entry FROM p WHERE ending NOT IN ('.txt', '') ORDER BY path"),
    "x18_enum_coerce": query(lambda s, d: table("customer", "c_custkey", "c_mktsegment").frame(s, d).select("c_custkey", manifests.coerced(F.element_at(F.array(*[F.lit(x) for x in ("auto", "green_screen", "black_background", "unknown")]), (F.col("c_custkey") % 4 + 1).cast("int")), manifests.BACKGROUNDS, "background mode").alias("mode"),
                                                                                                            manifests.coerced(F.element_at(F.array(*[F.lit(x) for x in manifests.QUALITIES]), (F.length("c_mktsegment") % 3 + 1).cast("int")), manifests.QUALITIES, "quality mode").alias("quality")),
                             "SELECT c_custkey, ['auto', 'green_screen', 'black_background', 'unknown'][c_custkey % 4 + 1] AS mode, ['fast', 'standard', 'high'][length(c_mktsegment) % 3 + 1] AS quality FROM customer"),
    "x10_exception_rules": query(lambda s, d: coded(s, d).select("event_id", "code"), f"SELECT event_id, {_CODE} AS code FROM events"),
    "x11_model_status_rules": query(lambda s, d: items(s, d).where(F.col("code").startswith("MODEL")).select("event_id", "code", "severity", "blocking", "title"),
                                    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'MODEL_RUNTIME_IMPORT_FAILED' WHEN 1 THEN 'MODEL_GPU_REQUIRED' ELSE 'MODEL_MISSING' END AS code, CASE WHEN event_id % 5 = 3 THEN 'warning' ELSE 'error' END AS severity, event_id % 5 <> 3 AS blocking, "
                                    "CASE event_id % 5 WHEN 0 THEN 'GVM runtime 不可用' WHEN 1 THEN 'SAM2 需要 CUDA' WHEN 3 THEN 'BiRefNet 不可用' ELSE 'rembg 不可用' END AS title FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 2"),
    "x12_media_tool_rules": query(lambda s, d: table("supplier", "s_suppkey", "s_name", "s_acctbal").frame(s, d).select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.concat(F.lit("/usr/bin/ffmpeg-"), F.col("s_name"))).alias("ffmpeg"), F.when(F.col("s_suppkey") % 3 > 0, F.lit("/usr/bin/ffprobe")).alias("ffprobe"))
                                  .withColumn("code", diagnostics.media_code(F.col("ffmpeg"), F.col("ffprobe"))).select("s_suppkey", "code", diagnostics.text_of(F.col("code"), 0).alias("title"), F.col("code").isNotNull().alias("blocking")),
                                  "SELECT s_suppkey, CASE WHEN NOT s_acctbal > 0 THEN 'FFMPEG_NOT_FOUND' WHEN s_suppkey % 3 = 0 THEN 'FFPROBE_NOT_FOUND' END AS code, CASE WHEN NOT s_acctbal > 0 THEN '未找到 FFmpeg' WHEN s_suppkey % 3 = 0 THEN 'FFprobe 缺失' END AS title, NOT s_acctbal > 0 OR s_suppkey % 3 = 0 AS blocking FROM supplier"),
    "x13_report_to_text": query(lambda s, d: diagnostics.user_text(items(s, d), "user_id", order="event_id").select("user_id", F.size(F.split("text", "\n")).alias("lines"), F.substring_index("text", "\n", 1).alias("first_line")), _user_text_sql()),
    "a36_diagnostic_counts": query(lambda s, d: diagnostics.counts(items(s, d), "user_id"), "SELECT user_id, sum(1 + (CASE WHEN event_id % 2 = 0 AND event_id % 5 IN (0, 1, 4) THEN 1 ELSE 0 END))::BIGINT AS blocking, count(CASE WHEN event_id % 2 = 0 AND event_id % 5 = 3 THEN 1 END) AS warning, 0::BIGINT AS info, false AS ok FROM events GROUP BY user_id"),
    "a07_region_supervision": query(supervision, _supervision_sql()),
}

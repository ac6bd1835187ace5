"""Reports, manifests, diagnoses, images, model hooks and the frame pipeline over real files and small tables."""

import json
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.frames import models, process, rules
from alphaloom.reports import diagnostics, manifests, regression
from alphaloom.settings import Settings
from alphaloom.sources import images, outputs, png


def report(score=0.9, holes=0, edge=0.01, **more):
    quality = {"overall_score": score, "mean_edge_uncertainty": edge, "speckle_pixels": 1, "hole_pixels": holes, "background_residue": 0.0, "temporal_flicker": 0.0, "edge_temporal_flicker": None, "transparent_temporal_flicker": None, "max_frame_delta": None}
    return {"job": {"input_path": "/in/clip_a.mp4"}, "quality": quality | more.pop("quality", {}), **more}


def gate(spark, tmp_path, payloads, base=None, **limits):
    for name, payload in payloads.items():
        at = tmp_path / name
        at.mkdir(parents=True, exist_ok=True)
        (at / "processing_report.json").write_text(payload if isinstance(payload, str) else json.dumps(payload))
    b = regression.baseline(spark.createDataFrame([(json.dumps(base),)], "raw string")) if base is not None else None
    run = regression.evaluate(regression.read_raw(spark, str(tmp_path)), b, regression.Thresholds(**limits), str(tmp_path))
    return run, {r.sample: r.failures for r in run.select("sample", "failures").collect()}


def test_threshold_texts(spark, tmp_path):
    low = report(0.7, 120, 0.2, quality={"temporal_flicker": 0.3, "edge_temporal_flicker": 0.09, "transparent_temporal_flicker": 0.1, "max_frame_delta": 0.2, "background_residue": 0.021},
                 p0_risks={"hair_edge_loss": {"score": 0.9, "level": "fail", "signals": {"hair_low_alpha_ratio": 0.4, "note": "x", "on": True}}, "transparent_effect_loss": {"score": 0.1, "signals": {"effect_low_alpha_ratio": 0.31}}, "odd": 1},
                 quality_selection={"available": True, "candidate_count": 0})
    run, got = gate(spark, tmp_path, {"a/one": low, "b": "{bad", "c": "[1]", "d": {"quality": {"overall_score": "0.95"}}, "e": report()})
    assert got["clip_a"] in ([], got["clip_a"]) and got["b"] == ["invalid processing report: malformed JSON"] and got["c"] == ["invalid processing report: top-level JSON must be an object"] and got["d"] == []
    texts = next(r.failures for r in run.collect() if "/a/one/" in r.path)
    assert texts == ["overall_score 0.700 below minimum 0.800", "mean_edge_uncertainty 0.200 above maximum 0.080", "hole_pixels 120 above maximum 100", "background_residue 0.021 above maximum 0.020", "temporal_flicker 0.300 above maximum 0.080",
                     "edge_temporal_flicker 0.090 above maximum 0.080", "transparent_temporal_flicker 0.100 above maximum 0.080", "max_frame_delta 0.200 above maximum 0.120", "hair_low_alpha_ratio 0.400 above maximum 0.300", "effect_low_alpha_ratio 0.310 above maximum 0.300",
                     "quality selection enabled but no candidates available", "p0 hair_edge_loss level fail"]
    total = regression.summary(run).first()
    assert (total.total, total.failed, total.status) == (5, 3, "fail")
    text = regression.markdown(run).first()[0]
    assert text.startswith("# Quality Regression Report\n\nStatus: FAIL\nSamples: 5\nPassed: 2\nFailed: 3\n") and "| e | " not in text and text.count("<br>") == 11 and text.endswith("|\n")
    whole = json.loads(regression.document(run).first()[0])
    assert whole["summary"] == {"status": "fail", "total_count": 5, "passed_count": 2, "failed_count": 3} and len(whole["samples"]) == 5 and whole["thresholds"]["max_hole_pixels"] == 100 and whole["samples"][0]["metrics"]["hole_pixels"] == 120


def test_numbers_in_texts_are_rounded_from_their_exact_value(spark, tmp_path):
    values = [k / 2000 for k in range(-41, 1801, 2)] + [k / 16 for k in range(-9, 40)] + [0.0, -0.0, 1e-9, 123456.0625]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", regression.fixed(F.col("v")).alias("three"), regression.fixed(F.col("v"), 12).alias("twelve"))
    assert [(r.three, r.twelve) for r in d.collect()] == [(f"{v:.3f}", f"{v:.12f}") for v in values]
    run, told = gate(spark, tmp_path, {"a": report(score=0.7625, edge=0.0845)})
    assert told["clip_a"] == ["overall_score 0.762 below minimum 0.800", f"mean_edge_uncertainty {0.0845:.3f} above maximum 0.080"]
    assert "| clip_a | FAIL | 0.762 | 0 |" in regression.markdown(run).first()["document"]


def test_risks_are_rounded_from_their_exact_value(spark, tmp_path):
    risk = {"hair_edge_loss": {"score": 0.625, "level": "warn", "signals": {}}}
    _, told = gate(spark, tmp_path, {"a": report(p0_risks=risk)}, {"clip_a": {"p0_risk.hair_edge_loss.score": 0.3125}})
    assert told["clip_a"] == ["p0 hair_edge_loss risk increased 0.312 from baseline 0.312"]


def test_baselines(spark, tmp_path):
    risks = {"hair_edge_loss": {"score": 0.5}, "background_residue": {"score": 0.5}}
    base = {"samples": {"clip_a": {"overall_score": 0.98, "p0_risk.hair_edge_loss.score": 0.2, "flag": True, "text": "1"}, "odd": 3}}
    _, got = gate(spark, tmp_path, {"x": report(0.9, p0_risks=risks)}, base)
    assert got == {"clip_a": ["overall_score dropped 0.080 from baseline 0.980", "p0 hair_edge_loss risk increased 0.300 from baseline 0.200"]}
    rows = regression.baseline(spark.createDataFrame([(json.dumps(base),), (json.dumps({"bare": {"m": 1}}),), ("[1]",), ("{bad",)], "raw string")).collect()
    assert {(r.sample, r.metric, r.value) for r in rows} == {("clip_a", "overall_score", 0.98), ("clip_a", "p0_risk.hair_edge_loss.score", 0.2), ("bare", "m", 1.0)}


def test_a_root_without_reports(spark, tmp_path):
    (tmp_path / "other.json").write_text("{}")
    none = spark.createDataFrame([], "path string, raw string")
    r = regression.evaluate(none, root=str(tmp_path)).first()
    assert r.failures == ["no processing_report.json files found"] and r.path.endswith("/processing_report.json") and not r.passed
    files = spark.createDataFrame([("/a/processing_report.json",), ("/a/b/processing_report.json",), ("/a/old_processing_report.json",), ("/ab/processing_report.json",)], "path string")
    assert {r.path for r in regression.discover(files, "/a").collect()} == {"/a/processing_report.json", "/a/b/processing_report.json"}
    assert [r.path for r in regression.discover(files, "/ab/processing_report.json").collect()] == ["/ab/processing_report.json"]


def test_manifests(spark):
    one = lambda text: manifests.samples(spark.createDataFrame([(text,)], "raw string")).collect()
    r = one('{"samples": [{"name": "n", "input_path": "a.mp4", "background_mode": "auto", "risk_ceilings": {"x": 0.5}}]}')[0]
    assert (r.quality_mode, r.candidate_models, r.risk_ceilings, r.expected_alpha_path, r.required_temporal_models) == ("standard", [], {"x": 0.5}, None, []) and one("{}") == []
    for bad, text in (("[1]", "top-level"), ('{"samples": {}}', "must be a list"), ('{"samples": [{"name": "n"}]}', "without"), ("{", "")):
        with pytest.raises(Exception, match=text):
            one(bad)
    made = manifests.generated(spark.createDataFrame([("assets/Green_1/a.b.MP4",), ("assets/x.png",), ("assets/Black/y.exr",), ("assets/z.txt",)], "path string"))
    assert {(r.name, r.background_mode) for r in made.collect()} == {("green_1_a.b", "green_screen"), ("x", "auto"), ("black_y", "black_background")}
    old = spark.createDataFrame([("kept", "assets/x.png", "black_background", None), ("gone", "other.png", "auto", "high")], "name string, input_path string, background_mode string, quality_mode string")
    got = {r.input_path: (r.name, r.background_mode, r.quality_mode, r.change) for r in manifests.merged(made.select(old.columns), old).collect()}
    assert got["assets/x.png"] == ("kept", "black_background", "standard", "updated") and got["other.png"] == ("gone", "auto", "high", "kept") and got["assets/Black/y.exr"][3] == "added"
    df = spark.createDataFrame([("green_screen",), ("nonsense",)], "m string")
    with pytest.raises(Exception, match="Unsupported mode: nonsense"):
        df.select(manifests.coerced(F.col("m"), manifests.BACKGROUNDS, "mode")).collect()


def test_region_expectations(spark):
    counts = spark.createDataFrame([("c", 100, 50, 0, 0, 0, 0, 10), ("d", 100, 1, 1, 1, 1, 1, 1)], "clip string, cells long, " + ", ".join(f"{r} long" for r in manifests.REGIONS))
    wanted = spark.createDataFrame([("c", ["subject", "hair_edge"], {"subject": 0.6, "uncertain_edge": 0.1})], "clip string, required array<string>, min_ratios map<string,double>")
    got = {r.clip: r.failures for r in manifests.expectation_failures(counts, wanted).collect()}
    assert got == {"c": ["required_region hair_edge missing", "region_ratio subject 0.500000 below minimum 0.600000"], "d": []}
    with pytest.raises(Exception, match="Unsupported region: sky"):
        manifests.expectation_failures(counts, spark.createDataFrame([("c", ["sky"], None)], "clip string, required array<string>, min_ratios map<string,double>")).collect()


def test_diagnoses(spark):
    rows = [(1, "ValueError", ["x", "Input Not Found: a"], "INPUT_INVALID"), (2, "ProgressCallbackError", ["input not found"], "PROGRESS_CALLBACK_FAILED"), (3, "RuntimeError", ["CUDA Out Of Memory"], "GPU_OUT_OF_MEMORY"), (4, "PermissionError", [], "OUTPUT_DIR_UNWRITABLE"),
            (5, "OSError", ["Read-only file system"], "OUTPUT_DIR_UNWRITABLE"), (6, "KeyError", ["a" * 5000 + " unsupported input"], "INPUT_INVALID"), (7, "KeyError", [""], "UNKNOWN_PROCESSING_ERROR")]
    df = spark.createDataFrame(rows, "k int, kind string, messages array<string>, want string")
    d = df.withColumn("code", diagnostics.exception_code(F.col("kind"), F.col("messages")))
    assert all(r.code == r.want for r in d.collect())
    items = d.select("k", F.lit("u").alias("u"), "code", F.lit("error").alias("severity"), diagnostics.text_of(F.col("code"), 0).alias("title"), diagnostics.text_of(F.col("code"), 1).alias("summary"), diagnostics.text_of(F.col("code"), 2).alias("actions"), F.lit(True).alias("blocking"))
    text = diagnostics.user_text(items, "u", order="k").first().text
    assert text.count("[error]") == 5 and text.startswith("[error] 输入素材无效: ") and "- 检查输入路径" in text
    status = spark.createDataFrame([("gvm", "GVM", False, "x 不可导入", True), ("rvm", None, True, None, None), ("sam", None, False, None, None)], "model_key string, display_name string, available boolean, reason string, auto_download boolean")
    got = {r.model_key: (r.code, r.severity, r.blocking, r.title) for r in diagnostics.model_items(status).collect()}
    assert got == {"gvm": ("MODEL_RUNTIME_IMPORT_FAILED", "warning", False, "GVM runtime 不可用"), "sam": ("MODEL_MISSING", "error", True, "sam 不可用")}


# --- images


def filtered_png(image, kinds):
    """A PNG whose rows use the given filters."""
    h, w, n = image.shape
    a = image.astype(int)
    rows = b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        out = []
        for x in range(w):
            left, up = a[y, x - 1] if x else np.zeros(n, int), a[y - 1, x] if y else np.zeros(n, int)
            corner = a[y - 1, x - 1] if x and y else np.zeros(n, int)
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            out.append((a[y, x] - [0 * left, left, up, (left + up) // 2, paeth][kind]) % 256)
        rows += bytes([kind]) + np.array(out, np.uint8).tobytes()
    whole = png.encode(image)
    start = whole.index(b"IDAT") - 4
    data = zlib.compress(rows)
    chunk = len(data).to_bytes(4, "big") + b"IDAT" + data + zlib.crc32(b"IDAT" + data).to_bytes(4, "big")
    return whole[:start] + chunk + whole[-12:]


def test_png():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        image = rng.integers(0, 256, (9, 7, n), dtype=np.uint8)
        assert (png.decode(png.encode(image)) == image).all() and (png.decode(filtered_png(image, [0, 1, 2, 3, 4])) == image).all()
    good = png.encode(image)
    for bad in (b"", good[:-4], good[:20], good[:40] + b"\1" + good[41:], b"GIF89a" + good):
        with pytest.raises(ValueError):
            png.decode(bad)
    with pytest.raises(ValueError):
        png.encode(np.zeros((2, 2, 5)))


def test_image_sequences(spark, tmp_path):
    rng = np.random.default_rng(3)
    pictures = {}
    for clip, names in (("b", ["2.png", "10.png", "1.PNG"]), ("a", ["x.png"])):
        (tmp_path / clip).mkdir()
        for n in names:
            pictures[clip, n] = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
            (tmp_path / clip / n).write_bytes(png.encode(pictures[clip, n]))
    (tmp_path / "b" / "0.png").write_bytes(b"broken")
    (tmp_path / "b" / "note.txt").write_text("no image")
    d = images.sequences(images.files(spark, str(tmp_path))).collect()
    got = {(r.clip.rsplit("/", 1)[1], r.frame_idx): r for r in d}
    assert set(got) == {("a", 0), ("b", 0), ("b", 1), ("b", 2)} and [got["b", k].path.rsplit("/", 1)[1] for k in range(3)] == ["1.PNG", "10.png", "2.png"]
    r = got["b", 2]
    assert (np.array([r.r, r.g, r.b]).T.reshape(5, 6, 3) == pictures["b", "2.png"]).all() and r.fps == 30.0
    meta = {r.clip.rsplit("/", 1)[1]: r for r in images.clip_metadata(images.sequences(images.files(spark, str(tmp_path)))).collect()}
    assert meta["b"].total_frames == 3 and (meta["b"].width, meta["b"].height) == (6, 5) and len(meta["b"].source_files) == 3
    with pytest.raises(Exception, match="too many frames"):
        images.sequences(images.files(spark, str(tmp_path)), 2).collect()
    assert images.frame_limit(spark.createDataFrame([(None, 1)], "clip string, frame_idx int"), 0).count() == 1
    assert {r.path.rsplit("/", 1)[1] for r in images.asset_files(spark, str(tmp_path), (".png",)).collect()} == {"0.png", "1.PNG", "2.png", "10.png", "x.png"}


def small(spark):
    rng = np.random.default_rng(4)
    rows = [(c, k, 10, 12, *[[float(v) for v in np.floor(rng.random(120) * 256)] for _ in range(3)], [float(v) for v in rng.random(120)]) for c in ("p", "q") for k in range(3)]
    return spark.createDataFrame(rows, "clip string, frame_idx long, height int, width int, r array<double>, g array<double>, b array<double>, ai array<double>")


def test_written_products(spark, tmp_path):
    d = small(spark).withColumn("a", F.col("ai"))
    out = process.products(d).select(F.concat(F.lit(f"{tmp_path}/"), "clip", F.lit("/"), "product", F.lit("/"), "frame_idx", F.lit(".png")).alias("path"), "content")
    assert images.write(out).count() == 24
    matte = images.alpha_values(images.files(spark, str(tmp_path / "p" / "Matte"))).collect()
    want = {r.frame_idx: np.floor(np.array(r.ai) * 255) / 255 for r in d.where("clip = 'p'").collect()}
    assert all(np.allclose(r.a, want[int(r.path.rsplit("/", 1)[1][0])]) for r in matte) and len(matte) == 3
    rgba = png.decode((tmp_path / "q" / "Processed" / "1.png").read_bytes())
    assert rgba.shape == (10, 12, 4) and not list(tmp_path.rglob("*.partial"))


# --- models and the pipeline


def test_generators(spark):
    def steady():
        def rule(f, state):
            return (f["ai"] if state is None else state), f["ai"]

        return rule

    def sometimes():
        def rule(f):
            if f["clip"] == "q" and f["frame_idx"] == 2:
                raise RuntimeError("out of weights")
            return {"alpha": f["ai"] * 255}

        return rule

    gens = [models.traditional(), models.Generator("last", steady, ("ai",), recurrent=True), models.Generator("some", sometimes, ("ai",)), models.Generator("none", None), models.Generator("off", steady, enabled=False), models.Generator("guided", steady, guidance="mask")]
    made, skipped = models.generate(small(spark), gens)
    rows = {(r.clip, r.candidate, r.frame_idx): r.a for r in made.collect()}
    data = {(r.clip, r.frame_idx): r.ai for r in small(spark).collect()}
    assert {(c, n) for c, n, _ in rows} == {("p", "traditional"), ("q", "traditional"), ("p", "last"), ("q", "last"), ("p", "some")}
    assert all(rows[c, "last", k] == data[c, max(0, k - 1)] for c in "pq" for k in range(3)) and np.allclose(rows["p", "some", 1], data["p", 1])
    why = {(r.clip, r.name): (r.reason, r.message) for r in skipped.collect()}
    assert why["q", "some"] == ("generation_failed", "RuntimeError: out of weights") and ("p", "some") not in why
    assert {n: why["p", n][0] for n in ("none", "off", "guided")} == {"none": "model_unavailable", "off": "disabled_by_config", "guided": "guidance_missing"}
    with pytest.raises(RuntimeError):
        models.generate(small(spark), [models.Generator("none", None)])


def test_model_outputs():
    a = np.array([[0.0, 0.5], [1.0, 0.25]])
    for form in (a, {"pha": a}, [a], a[None, :, :, None], (a * 255), {"matte": a * 255}):
        assert np.allclose(models.checked(form, (2, 2)), a)
    assert (models.checked(None, (2, 3)) == 1).all() and models.checked(a, (4, 4)).shape == (4, 4)
    with pytest.raises(ValueError):
        models.checked(np.zeros(5), (2, 2))


def test_first_ready(spark):
    rows = [(1, "gvm", False, None), (1, "rvm", True, None), (1, "rembg", True, "auto"), (2, "gvm", True, "rvm"), (2, "rvm", False, "rvm"), (3, "gvm", False, None), (4, "gvm", True, "sam")]
    got = {r.n: r.engine for r in models.first_ready(spark.createDataFrame(rows, "n int, engine string, ready boolean, requested string"), "n").collect()}
    assert got == {1: "rembg", 2: "rvm", 3: None, 4: None}


def test_pipeline_against_its_rules(spark):
    s = Settings(background="green_screen", despeckle_radius=1)
    out, told = process.processed(small(spark), s)
    got = {(r.clip, r.frame_idx): r for r in out.collect()}
    for clip in ("p", "q"):
        rows = [r for r in small(spark).orderBy("frame_idx").collect() if r.clip == clip]
        pics = [rules.Picture(*[np.array(c).reshape(10, 12) for c in (r.r, r.g, r.b)]) for r in rows]
        base = [rules.green_alpha(p) for p in pics]
        alphas = []
        for p, a in zip(pics, base):
            x = rules.refined(a, rules.ownership(p, a, a))[0]
            x = rules.despeckled(x, 1, 0.0, p, rules.ownership(p, x, a))
            alphas.append(rules.prop_restored(x, rules.green_alpha(p), rules.ownership(p, x, a)))
        alphas = rules.adaptive(alphas)
        own = [rules.ownership(p, a, b) for p, a, b in zip(pics, alphas, base)]
        clean = [rules.Picture(*rules.green_spill_removed(p, a, o)) for p, a, o in zip(pics, alphas, own)]
        strict = [rules.screen_pixels(p, a, True) for p, a in zip(clean, alphas)]
        bag = [np.concatenate([c[m] for c, m in zip([getattr(p, k) for p in clean], strict)]) for k in "rgb"]
        screen = tuple(float(np.median(v)) for v in bag) if len(bag[0]) else (0.0, 255.0, 0.0)
        for r, p, a, o in zip(rows, clean, alphas, own):
            g = got[clip, r.frame_idx]
            assert np.allclose(g.a, a.ravel()) and g.subject == o["subject"].ravel().tolist()
            assert np.allclose(np.array([g.r, g.g, g.b]), np.array([c.ravel() for c in rules.recovered(p, a, o, screen)[0]]))
    report = {r.clip: r for r in told.collect()}
    assert report["p"].frames == 3 and len(report["p"].risks) == 6 and report["q"].keyed == "green_screen"


def test_settings_and_backgrounds(spark):
    with pytest.raises(ValueError, match="unknown option: nonsense"):
        Settings().with_overrides(nonsense=1)
    assert Settings().with_overrides(key_strength=0.9).key_strength == 0.9
    flat = lambda c, rgb, n: [(c, k, 40, 40, *[[float(v)] * 1600 for v in rgb], [0.5] * 1600) for k in range(n)]
    d = spark.createDataFrame(flat("g", (0, 200, 60), 7) + flat("k", (2, 2, 2), 1) + flat("u", (120, 120, 125), 2), small(spark).schema)
    got = {r.clip: r.background for r in process.background_scores(d).collect()}
    assert got["g"] == "green_screen" and got["k"] == "black_background" and got["u"] == "unknown"
    out, told = process.processed(d, Settings(quality="fast"))
    keyed = {r.clip: (r.background_mode_effective, r.keyed) for r in told.collect()}
    assert keyed["g"] == ("green_screen", "green_screen") and keyed["k"][1] == "black_background" and keyed["u"][0] == "unknown" and keyed["u"][1] != "unknown"
    assert {max(r.a) for r in out.where("clip = 'g'").collect()} == {0.0}
    chosen, told = process.processed(small(spark), Settings(background="green_screen", quality="fast"), [models.traditional(), models.Generator("gone", None)])
    assert {s.name for s in told.first().skipped} == {"gone"} and chosen.count() == 6
    merged, _ = process.processed(small(spark), Settings(background="green_screen", quality="fast", model="gvm"))
    assert merged.count() == 6


def test_output_folders(tmp_path):
    now = datetime(2024, 1, 2, 3, 4, 5)
    make = lambda: outputs.output_dir("/in/my clip.mp4", str(tmp_path), now=now)
    first = make()
    assert first.name == "my_clip" and make() == first
    (first / "x").write_text("")
    assert [make().name, make().name, make().name] == ["my_clip_20240102_030405", "my_clip_20240102_030405_2", "my_clip_20240102_030405_3"]
    assert outputs.sanitized(' <a:b> /"|?* ') == "a_b" and outputs.sanitized("...") == "output" and outputs.output_dir("a.png", str(tmp_path), "t 1").name == "a_t_1"
    at = outputs.written_whole(b"data", str(tmp_path / "m" / "w.bin"))
    assert at.read_bytes() == b"data"
    outputs.check_model_file(str(at), "m", 4)
    for least, kind in ((5, ValueError),):
        with pytest.raises(kind):
            outputs.check_model_file(str(at), "m", least)
    with pytest.raises(FileNotFoundError):
        outputs.check_model_file(str(at) + "x", "m", 1)
    with pytest.raises(ValueError):
        outputs.written_whole(b"short", str(tmp_path / "n.bin"), lambda p: outputs.check_model_file(str(p), "n", 99))
    assert not (tmp_path / "n.bin").exists() and not list(tmp_path.rglob("*.partial"))
    assert outputs.media_tools(lambda t: None, lambda p: p == "/opt/x/ffmpeg", ("/opt/y", "/opt/x"))["source"] == "/opt/x" and outputs.media_tools(lambda t: f"/bin/{t}")["ffprobe"] == "/bin/ffprobe"

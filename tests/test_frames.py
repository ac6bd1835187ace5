"""Frame kernels against plain loops, and the rules against known answers; over DataFrames of frames of several sizes."""

import colorsys

import numpy as np
import pytest

from alphaloom import api as queries
from alphaloom.frames import api, grid, rules
from alphaloom.frames.rules import Picture

RNG = np.random.default_rng(5)


def some(h, w):
    return Picture(*[np.floor(RNG.random((h, w)) * 256) for _ in range(3)]), RNG.random((h, w))


def frame(clip, idx, a, ai=None, p=None):
    h, w = a.shape
    flat = lambda x: [float(v) for v in np.ravel(x)]
    p = p or Picture(*[np.zeros(a.shape)] * 3)
    return (clip, idx, h, w, flat(a), flat(a if ai is None else ai), flat(p.r), flat(p.g), flat(p.b))


SCHEMA = "clip string, frame_idx long, height int, width int, a array<double>, ai array<double>, r array<double>, g array<double>, b array<double>"


# --- primitives


def plain_components(mask, diagonal):
    h, w = mask.shape
    lab, n = np.zeros((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not lab[y, x]:
                n += 1
                todo = [(y, x)]
                lab[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or i == 0 or j == 0):
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and not lab[c, d]:
                            lab[c, d] = n
                            todo.append((c, d))
    return lab


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    for _ in range(40):
        m = RNG.random((RNG.integers(1, 30), RNG.integers(1, 30))) > RNG.random()
        labels, areas = grid.components(m, diagonal)
        assert (labels == plain_components(m, diagonal)).all() and (np.bincount(labels.ravel(), minlength=len(areas)) == areas).all()
    snake = np.zeros((41, 41), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert set(grid.components(snake)[0][snake]) == {1}


def test_elements():
    assert [w for _, w in grid.ellipse(3)] == [0, 1, 0] and [w for _, w in grid.ellipse(5)] == [0, 2, 2, 2, 0] and [w for _, w in grid.ellipse(11)] == [0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0]


def neighbours(shape, y, x, element):
    return [(y + dy, x + dx) for dy, w in element for dx in range(-w, w + 1) if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]]


def test_morphology_distance_and_filters():
    a = RNG.random((17, 23))
    for e in (grid.ellipse(5), grid.ellipse(19), grid.square(9), grid.ellipse(81)):
        want = np.array([[max(a[q] for q in neighbours(a.shape, y, x, e)) for x in range(23)] for y in range(17)])
        assert (grid.dilate(a, e) == want).all() and (grid.erode(-a, e) == -want).all()
        assert (grid.dilate(a > 0.9, e) == (want > 0.9)).all()
    m = RNG.random((17, 23)) > 0.95
    ys, xs = np.nonzero(m)
    want = np.array([[np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()) for x in range(23)] for y in range(17)])
    assert np.allclose(grid.distance(m, 40), want) and (np.isinf(grid.distance(m, 3)) == (want > 3)).all()
    u = np.floor(a * 255)
    clamp = lambda y, x: u[min(16, max(0, y)), min(22, max(0, x))]
    want = np.array([[np.median([clamp(y + i, x + j) for i in range(-3, 4) for j in range(-3, 4)]) for x in range(23)] for y in range(17)])
    assert (grid.median(u, 7) == want).all() and (grid.median(u, 7, band=1) == want).all()
    mirror = lambda i, n: (n - 1) - abs((n - 1) - abs(i))
    k = grid.gaussian_kernel(5)
    want = np.array([[sum(k[i + 2] * k[j + 2] * a[mirror(y + i, 17), mirror(x + j, 23)] for i in range(-2, 3) for j in range(-2, 3)) for x in range(23)] for y in range(17)])
    assert np.allclose(grid.blurred(a, 5), want)
    want = np.array([[sum(a[q] for q in neighbours(a.shape, y, x, grid.square(5))) for x in range(23)] for y in range(17)])
    assert np.allclose(grid.box_sum(a, 5), want)


def test_filling():
    ring = np.zeros((12, 12), bool)
    ring[2:9, 2:9] = True
    ring[4:7, 4:7] = False
    assert grid.filled(ring).sum() == 49 and grid.filled(ring, 36).sum() == 49 and grid.filled(ring, 36.5).sum() == 0  # 7 x 7 cells have an outline of 6 x 6
    allowed = np.ones_like(ring)
    allowed[5, 5] = False
    assert grid.fill_holes(ring, allowed).sum() == 48
    small = np.zeros((9, 9), bool)
    small[2:5, 2:5] = True
    small[3, 3] = False
    assert (grid.fill_holes(small, np.ones_like(small)) == small).all()  # an outline of 4 is too small
    line = np.zeros((5, 20), bool)
    line[2] = True
    assert grid.filled(line, 0.1).sum() == 0 and grid.filled(line).sum() == 20


def test_translation():
    b = RNG.random((64, 64)) * 0.01
    b[20:30, 22:40] += 1
    dx, dy = grid.translation(b, np.roll(np.roll(b, 3, 0), -5, 1))
    assert abs(dx + 5) < 0.1 and abs(dy - 3) < 0.1
    a = np.zeros((6, 6))
    a[2, 2] = 1
    assert grid.shifted(a, 1, 2)[4, 3] == 1 and np.allclose(grid.shifted(a, 0.5, 0)[2, 2:4], 0.5) and grid.shifted(a, 9, 0).sum() == 0


# --- known answers


def test_quality_known_answers():
    a = np.zeros((10, 10))
    a[1:4, 1:4], a[6:9, 6:9], a[5, 6:9] = 0.5, 1.0, 0.5
    assert rules.measured(a)["edge"] == 0.03
    for cols, holes in ((slice(5, 7), 0), (slice(5, 8), 6)):
        h = np.ones((12, 12))
        h[5:7, cols] = 0.69
        assert rules.measured(h)["holes"] == holes


def masks(shape, **where):
    out = {k: np.zeros(shape, bool) for k in rules.REGIONS}
    for k, cells in where.items():
        for c in cells:
            out[k][c] = True
    return out


def test_region_scores_known_answer():
    own = masks((2, 2), subject=[(0, 0)], hair_edge=[(0, 1)], uncertain_edge=[(0, 1)], background_residue=[(1, 1)])
    s = rules.region_scores(np.array([[1, 0.5], [0, 0]]), own)
    assert s["subject"] == 1.0 and s["background_residue"] == 1.0 and s["hair_edge"] > 0.9


def test_selection_known_answers():
    good, effect = np.array([[1, 0], [0.1, 0.9]]), np.array([[0.4, 0.6], [0.45, 0]])
    own = masks((2, 2), subject=[(0, 0)], hair_edge=[(0, 1)], uncertain_edge=[(0, 1)], luminous_prop=[(1, 0)], transparent_effect=[(1, 0)], background_residue=[(1, 1)])
    got = rules.selected([good, effect], own)
    assert got["alpha"][0, 0] == 1.0 and got["alpha"][1, 0] == 0.45 and got["alpha"][1, 1] == 0.0 and {k for _, k, _, _ in got["decisions"]} == {0, 1}
    hair = masks((2, 2), hair_edge=[(0, 0), (0, 1)])
    a, b = np.array([[0.45, 0.55], [0, 0]]), np.array([[0.25, 0.75], [0, 0]])
    assert [k for _, k, _, _ in rules.selected([a, b], hair, [{"overall": 0.70, "hair_edge": 0.62}, {"overall": 0.60, "hair_edge": 0.64}])["decisions"]] == [0]
    assert [k for _, k, _, _ in rules.selected([a, b], hair, [{"overall": 0.70, "hair_edge": 0.62}, {"overall": 0.67, "hair_edge": 0.67}])["decisions"]] == [1]
    risky = np.ones((7, 7))
    risky[2:5, 2:5] = 0
    own = {k: np.zeros((7, 7), bool) for k in rules.REGIONS} | {"subject": np.ones((7, 7), bool)}
    got = rules.selected([np.ones((7, 7)), risky], own, [{"overall": 0.90, "subject": 0.90}, {"overall": 0.95, "subject": 0.95}])
    assert (got["alpha"] == 1).all() and got["fallback"] == 0 and "hole_pixels" in got["reasons"] and got["chosen"]["holes"] == 9 and got["safe"]["holes"] == 0 and got["chosen"]["score"] < got["safe"]["score"]
    own["subject"] = risky > 0
    own["hair_edge"] = risky == 0
    got = rules.selected([np.ones((7, 7)), risky], own, [{"overall": 0.90, "subject": 0.95, "hair_edge": 0.50}, {"overall": 0.92, "subject": 0.10, "hair_edge": 0.95}])
    assert (got["alpha"] == 1).all() and "edge_takeover" in got["reasons"] and [k for _, k, _, _ in got["decisions"]] == [0, 0]


def test_fusion_guard_known_answers():
    for rows, holes, exact in ((slice(2, 5), 9, False), (slice(2, 4), 6, True)):
        fused = np.ones((7, 7))
        fused[rows, 2:5] = 0
        lost = fused < 0.5
        out, reasons, a, b = rules.fusion_guarded(fused, np.ones((7, 7)), ~lost, np.zeros((7, 7)), lost)
        assert (out == 1).all() and a["holes"] == holes and b["holes"] == 0 and {"hole_pixels", "edge_takeover"} <= set(reasons)
        assert not exact or reasons == ["hole_pixels", "overall_score", "edge_takeover"]


def test_adaptive_smoothing_by_hand():
    got = [float(x[0, 0]) for x in rules.adaptive([np.array([[v]]) for v in (0.0, 0.5, 1.0)])]
    f1 = 0.8 * 0.5 + 0.2 * 0.0
    w = min(1, 3 * abs(1 - f1)) * 0.5 * 0.1
    f2 = (1 - w) * 1.0 + w * f1
    b1 = 0.8 * f1 + 0.2 * f2
    w = min(1, 3 * abs(0 - b1)) * 0.25 * 0.1
    assert np.allclose(got, [w * b1 / 2, (f1 + b1) / 2, f2])


def test_colours():
    p, _ = some(20, 20)
    h, s, v = rules.hsv_of(p.r, p.g, p.b)
    for y, x in ((0, 0), (3, 7), (19, 19)):
        want = colorsys.rgb_to_hsv(*(c[y, x] / 255 for c in (p.r, p.g, p.b)))
        assert abs(h[y, x] - want[0] * 180) <= 1 and abs(s[y, x] - want[1] * 255) <= 1 and v[y, x] == max(c[y, x] for c in (p.r, p.g, p.b))
    assert max(np.abs(x - y).max() for x, y in zip(rules.rgb_of(h, s, v), (p.r, p.g, p.b))) <= 6
    gray = Picture(*[np.full((4, 4), 200.0)] * 3)
    assert all((c == 200).all() for c in rules.black_spill_removed(gray, np.ones((4, 4))))
    dark = Picture(*[np.full((4, 4), 20.0)] * 3)
    assert rules.black_spill_removed(dark, np.full((4, 4), 0.5))[0].min() > 20
    screen = Picture(np.zeros((30, 30)), np.full((30, 30), 200.0), np.full((30, 30), 60.0))
    assert rules.green_screen_colour(screen, np.zeros((30, 30))) == (0, 200, 60)
    assert rules.chroma_key(screen).max() == 0 and rules.chroma_key(gray).min() == 1


def blob(h, w, *boxes):
    m = np.zeros((h, w), bool)
    for t, l, b, r in boxes:
        m[t:b, l:r] = True
    return m


def test_topology_rules():
    h = w = 120
    paint = lambda m, c, rest=(30, 30, 30): Picture(*[np.where(m, float(x), float(y)) for x, y in zip(c, rest)])
    lamp = blob(h, w, (20, 20, 40, 40))
    lamp[26:34, 26:34] = False
    p = paint(lamp, (220, 160, 60))
    found = rules.luminous(p, np.ones((h, w)))
    assert found[30, 30] and found[20, 20] and not found[80, 80]  # what the shell encloses belongs to it
    assert not rules.luminous(paint(blob(h, w, (20, 20, 22, 22)), (220, 160, 60)), np.ones((h, w))).any()  # too small
    page = blob(h, w, (20, 20, 70, 70))
    p = paint(page, (230, 230, 230))
    assert (rules.document_evidence(p, np.ones((h, w))) == page).all()
    assert not rules.document_evidence(paint(blob(h, w, (90, 50, 96, 56)), (230, 230, 230)), np.ones((h, w))).any()
    own = rules.ownership(p, np.full((h, w), 0.5))
    assert own["transparent_effect"][30, 30] and not own["subject"].any()
    own = rules.ownership(p, np.full((h, w), 0.85))
    assert own["background_residue"].sum() == page.sum() and not own["subject"][30, 30] and own["subject"][100, 100]
    light = blob(h, w, (50, 50, 56, 56))
    p = paint(light, (240, 240, 240))
    layer = rules.luminous_reconstruction(p, np.zeros((h, w)))
    assert layer[52, 52] == 1 and layer[0, 0] == 0
    halo = Picture(np.where(light, 240.0, 100.0), np.where(light, 240.0, 160.0), np.where(light, 240.0, 200.0))
    band = rules.cyan_halo(light, halo, np.zeros((h, w)))
    assert band[49, 52] > band[44, 52] > 0 and band[20, 20] == 0 and band[52, 52] == 0
    far = rules.background_evidence(halo, np.zeros((h, w)))
    assert far[5, 5] and not far[49, 52] and not far[52, 52]
    seed = blob(h, w, (30, 30, 60, 60), (30, 70, 60, 90))
    whole = rules.subject_instance(seed)
    assert whole[45, 65] and whole[seed].all() and not rules.subject_instance(np.zeros((h, w), bool)).any()
    sure = np.ones((200, 200))
    core = rules.subject_core(sure, sure, sure, 0 * sure)
    assert core.all() and not rules.subject_core(sure, sure, sure, sure).any()
    edge = sure.copy()
    edge[:, :100] = 0
    core = rules.subject_core(edge, sure, sure, 0 * sure)
    assert core[100, 150] and not core[100, 105]
    skin = paint(blob(200, 200, (20, 20, 180, 180)), (150, 100, 120))
    ai = blob(200, 200, (20, 20, 180, 180)).astype(float)
    ai[90:110, 90:110] = 0
    base = np.where(ai > 0, 0.9, 0.3)
    lifted = rules.subject_integrity(skin, ai, base, ai)
    assert lifted[100, 100] > 0.5 and lifted[30, 30] == 0 and rules.subject_integrity(skin, ai, base, ai, "rvm").sum() == 0


def test_layers_compete():
    one = lambda v: np.full((1, 1), v)
    got = lambda s, e, b=0.0: [float(x[0, 0]) for x in rules.composed(tuple(map(one, s)), tuple(map(one, e)), one(b))]
    assert got((0.9, 0.9, 0.9), (0.2, 0.2, 0.2)) == [0.9, 1, 0, 0] and got((0.3, 0.3, 0.3), (0.8, 0.8, 0.8)) == [0.8, 0, 1, 0]
    assert got((0.1, 0.1, 0.1), (0.3, 0.3, 0.3)) == [0, 0, 0, 1] and got((0.8, 0.8, 0.5), (0.4, 0.4, 0.4), 0.6) == [0, 0, 0, 1]
    p, a = some(40, 50)
    ai = RNG.random((40, 50))
    for model in (None, "gvm"):
        out = rules.green_merged(p, a, ai, model=model)
        assert out.shape == (40, 50) and 0 <= out.min() and out.max() <= 1
    assert (rules.green_merged(p, a, ai, preserve=0.0) == ai).all()
    solid = Picture(*[np.full((40, 50), 200.0)] * 3)
    assert (rules.green_merged(solid, np.ones((40, 50)), np.ones((40, 50))) == 1).all()


def test_resizing():
    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(rules.resized(a, 3, 4), a) and rules.resized(a, 6, 8).shape == (6, 8) and np.allclose(rules.resized(np.ones((5, 1)), 2, 7), 1)
    assert np.allclose(rules.resized(np.array([[0.0, 1.0]]), 1, 4), [[0, 0.25, 0.75, 1]]) and rules.padded_to(a).shape == (32, 32)


# --- over DataFrames


@pytest.fixture(scope="module")
def sized(spark):
    """Frames of three sizes, in two clips."""
    rows = []
    for idx, (h, w) in enumerate(((8, 8), (8, 8), (8, 8))):
        p, a = some(h, w)
        rows.append(frame("small", idx * 3, a, RNG.random((h, w)), p))
    for idx in range(4):
        p, a = some(33, 70)
        rows.append(frame("wide", idx, a, RNG.random((33, 70)), p))
    p, a = some(1, 5)
    rows.append(frame("line", 0, a, a, p))
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    return {(r.clip, r.frame_idx): np.array(r.a).reshape(r.height, r.width) for r in df.collect()}


def test_quality_of_clips(sized):
    data = arrays(sized)
    for r in api.quality(sized).collect():
        series = [data[k] for k in sorted(data) if k[0] == r.clip]
        parts = [rules.measured(a) for a in series]
        flick = np.mean([np.abs(x - y).mean() for x, y in zip(series, series[1:])]) if len(series) > 1 else 0
        art = (sum(p["holes"] + p["speckles"] for p in parts)) / sum(a.size for a in series)
        want = rules.score(np.mean([p["edge"] for p in parts]), np.mean([p["residue"] for p in parts]), flick, art)
        assert r.frames == len(series) and np.isclose(r.overall_score, want) and np.isclose(r.flicker, flick)


def test_pack_and_cells(spark, sized):
    px = api.cells(sized, "a", "r", "g", "b", "ai")
    back = api.pack(px, "a")
    assert {k: v.tolist() for k, v in arrays(back).items()} == {k: v.tolist() for k, v in arrays(sized).items()}
    with pytest.raises(Exception, match="aren't each there once"):
        api.pack(px.where("not (clip = 'wide' and y = 3 and x = 4)"), "a").collect()
    with pytest.raises(Exception, match="aren't each there once"):
        api.pack(px.union(px.where("clip = 'line' and x = 0")), "a").collect()


@pytest.mark.parametrize("tile", [1 << 24, 100])
def test_stabilised_clips(sized, tile, monkeypatch):
    monkeypatch.setattr(api, "TILE_VALUES", tile)
    data = arrays(sized)
    for mode, rule in (("fast", rules.ema), ("standard", rules.adaptive)):
        got = {(r.clip, r.frame_idx): np.array(r.alpha).reshape(r.height, r.width) for r in api.stabilise(sized, mode).collect()}
        for clip in ("small", "wide", "line"):
            keys = sorted(k for k in data if k[0] == clip)
            series = [data[k] for k in keys]
            want = rule(series) if len(series) > 1 else series
            assert all(np.allclose(got[k], x) for k, x in zip(keys, want))
    with pytest.raises(ValueError):
        api.stabilise(sized, "none")


def test_flow_follows_a_moving_box(spark):
    rows = []
    for k in range(4):
        c = np.full((48, 64), 20.0)
        c[15:30, 10 + 4 * k : 25 + 4 * k] = 220
        a = (c > 100).astype(float)
        if k == 2:
            a[20:25, 20:28] = 0  # a hole that the frame before doesn't have
        rows.append(frame("m", k, a, a, Picture(c, c, c)))
    got = {r.frame_idx: np.array(r.alpha).reshape(48, 64) for r in api.stabilise(spark.createDataFrame(rows, SCHEMA), "high").collect()}
    assert abs(got[2][22, 24] - 0.5) < 0.05 and got[2][5, 5] < 0.05 and got[1][20, 20] > 0.95


def test_risks_of_larger_frames(sized):
    own = api.regions(sized)
    got = {(r.clip, r.risk): r for r in api.risks(own).collect()}
    assert len(got) == 18 and [r for _, r in sorted((v.ord, k[1]) for k, v in got.items() if k[0] == "wide")] == list(api.RISKS)
    frames = [r for r in own.collect() if r.clip == "wide"]
    shares = [np.mean(r.subject) for r in frames]
    s = got["wide", "subject_misidentification"]
    assert np.isclose(s.signals["subject_coverage_ratio"], np.mean(shares), atol=1e-6) and np.isclose(s.signals["subject_coverage_ratio_p95"], np.percentile(shares, 95), atol=1e-6)
    assert np.isclose(s.signals["subject_coverage_ratio_top3_mean"], np.mean(sorted(shares)[-3:]), atol=1e-6)


def test_queries_run_over_bound_tables(spark, sized):
    whole = queries.run("a01_alpha_quality", spark, frames=sized)
    assert {r.clip: r.frames for r in whole.collect()} == {"small": 3, "wide": 4, "line": 1}
    px = api.cells(sized, "a", "ai", "r", "g", "b")
    edge = {tuple(r) for r in queries.run("n01_uncertain_edge", spark, pixels=px).collect()}
    want = {(c, i, int(y), int(x)) for (c, i), a in arrays(sized).items() for y, x in zip(*np.nonzero(rules.edge_mask(a)))}
    assert edge == want
    assert queries.run("p18_green_despill", spark, frames=sized).count() == 3 * 64 + 4 * 33 * 70 + 5
    assert queries.run("r03_region_select", spark, frames=sized).count() == 3 * 64 + 4 * 33 * 70 + 5
    with pytest.raises(ValueError):
        queries.run("a01_alpha_quality", spark, frames=sized.drop("ai"))
    with pytest.raises(ValueError):
        queries.run("a01_alpha_quality", spark, others=sized)


def test_selection_over_dataframes(spark):
    own = [("c", 0, 7, 7, *[[bool(v) for v in np.ravel(m)] for m in ({k: np.zeros((7, 7), bool) for k in rules.REGIONS} | {"subject": np.ones((7, 7), bool)}).values()])]
    owned = spark.createDataFrame(own, "clip string, frame_idx long, height int, width int, " + ", ".join(f"{k} array<boolean>" for k in rules.REGIONS))
    risky = np.ones((7, 7))
    risky[2:5, 2:5] = 0
    cands = spark.createDataFrame([("c", 0, k, n, [float(v) for v in np.ravel(a)]) for k, (n, a) in enumerate((("stable", np.ones((7, 7))), ("risky", risky)))], "clip string, frame_idx long, ord int, candidate string, a array<double>")
    scores = spark.createDataFrame([("c", 0, "stable", 0.90, 0.90), ("c", 0, "risky", 0.95, 0.95)], "clip string, frame_idx long, candidate string, overall double, subject double")
    r = api.select(cands, owned, scores).first()
    assert set(r.alpha) == {1.0} and r.fallback == "stable" and "hole_pixels" in r.reasons and r.selected_holes == 9 and r.fallback_holes == 0 and [d.candidate for d in r.decisions] == ["stable"]
    assert api.select(cands, owned).count() == 1


def test_nulls_are_refused(spark):
    df = spark.createDataFrame([("c", 0, 1, 2, [1.0, None])], "clip string, frame_idx long, height int, width int, a array<double>")
    with pytest.raises(Exception, match="null in a"):
        api.per_frame(df, lambda f: {"m": float(f["a"].mean())}, "m double", "a").collect()


def test_frame_rules_need_no_shuffle(sized):
    plan = api.per_frame(sized, lambda f: rules.measured(f["a"]), api.MEASURED, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan

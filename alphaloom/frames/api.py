"""Operators on DataFrames of frames of any size.

A frame is one row: clip, frame_idx, height, width, and its values row by row as arrays (a and
ai: alphas on 0..1, r, g and b: colours on 0..255; others at will). pack() makes frames of pixel
rows, cells() pixel rows of frames. Rules on one frame run over Arrow batches of frames, without a
shuffle. What compares neighbouring frames joins them by their number within the clip, so a long clip
is never one task's work; recurrences over a clip run in tiles of rows, each with all frames of the clip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alphaloom.frames import rules
from alphaloom.frames.rules import REGIONS, Picture

KEYS = ["clip", "frame_idx"]
#: Values of a tile of a clip in a recurrence: rows of the frame times its width times the frames of the clip.
TILE_VALUES = 1 << 24


def _field(*path: str) -> Callable[[Column], Column]:
    def get(c: Column) -> Column:
        for name in path:
            c = c[name]
        return c

    return get


def pack(pixels: DataFrame, *values: str, keys: tuple[str, ...] = ("clip", "frame_idx")) -> DataFrame:
    """Frames of pixel rows (keys, y, x, values); an error where a frame's cells aren't each there once."""
    rows = pixels.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"), F.array_sort(F.collect_list(F.struct("y", "x", *values))).alias("_cells"))
    h, w = (F.col("_h") + 1).cast("int"), (F.col("_w") + 1).cast("int")
    whole = (F.size("_cells") == h * w) & (F.size(F.array_distinct(F.transform("_cells", lambda c: F.struct(c["y"], c["x"])))) == h * w) & F.forall("_cells", lambda c: (c["y"] >= 0) & (c["x"] >= 0))
    checked = rows.withColumn("_cells", F.when(whole, F.col("_cells")).otherwise(F.raise_error(F.lit("a frame's cells aren't each there once"))))
    return checked.select(*keys, h.alias("height"), w.alias("width"), *[F.transform("_cells", _field(v)).alias(v) for v in values])


def cells(frames: DataFrame, *values: str, keys: tuple[str, ...] = ("clip", "frame_idx")) -> DataFrame:
    """Pixel rows (keys, y, x, values) of frames."""
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    at = frames.select(*keys, "width", F.posexplode(zipped).alias("_p", "_v"))
    return at.select(*keys, F.expr("cast(_p div width as int)").alias("y"), F.expr("cast(_p % width as int)").alias("x"), *[F.col(f"_v.{v}").alias(v) for v in values])


class Frame:
    """One row: values as arrays of height x width, other columns as they are."""

    def __init__(self, row: dict, height: int, width: int):
        self.row, self.shape = row, (height, width)

    def __getitem__(self, name: str):
        v = self.row[name]
        return v.reshape(self.shape) if isinstance(v, np.ndarray) else v

    def __contains__(self, name: str) -> bool:
        return name in self.row

    @property
    def picture(self) -> Picture:
        return Picture(self["r"], self["g"], self["b"])

    def own(self) -> dict[str, np.ndarray]:
        return {k: self[k] for k in REGIONS}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    cols = []
    for name, col in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(col.type):
            if col.null_count or col.values.null_count:
                raise ValueError(f"null in {name}")
            flat, at = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            cols.append([flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:])])
        else:
            cols.append(col.to_pylist())
    for row in zip(*cols):
        yield dict(zip(batch.schema.names, row))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in schema:
        values = [r[f.name] for r in rows]
        if pa.types.is_list(f.type) and (not values or isinstance(values[0], np.ndarray)):
            flat = [np.ravel(v) for v in values]
            offsets = np.cumsum([0, *map(len, flat)])
            joined = pa.array(np.concatenate(flat) if flat else [], f.type.value_type)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), joined))
        else:
            cols.append(pa.array([v.item() if isinstance(v, np.generic) else v for v in values], f.type))
    return pa.RecordBatch.from_arrays(cols, [f.name for f in schema])


def per_frame(frames: DataFrame, rule: Callable[[Frame], dict], out: str, *need: str, keep: tuple[str, ...] = ("clip", "frame_idx", "height", "width")) -> DataFrame:
    """A rule on each frame: the kept columns and what it returns (out: its names and types). Only the needed columns are read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    more = StructType.fromDDL(out)
    src = frames.select(*dict.fromkeys([*keep, "height", "width", *need]))
    kind = StructType([src.schema[k] for k in keep] + list(more))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in _rows(batch):
                rows.append({k: row[k] for k in keep} | rule(Frame(row, row["height"], row["width"])))
                size += row["height"] * row["width"]
                if size > 1 << 22:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            yield _batch(rows, arrow)

    return src.mapInArrow(run, kind)


def numbered(frames: DataFrame) -> DataFrame:
    """Frames with their number n within the clip; only keys are sorted, and the numbers come back by an equi-join."""
    n = frames.select(*KEYS).withColumn("n", F.row_number().over(Window.partitionBy("clip").orderBy("frame_idx")))
    return frames.join(n, KEYS)


def pairs(frames: DataFrame, *values: str) -> DataFrame:
    """Each frame but the first of a clip beside the one before it, whose values are named before_<value>."""
    d = numbered(frames.select(*KEYS, "height", "width", *values))
    before = d.select("clip", (F.col("n") + 1).alias("n"), *[F.col(v).alias(f"before_{v}") for v in values])
    return d.join(before, ["clip", "n"])


def mean_difference(a: str, b: str) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def flicker(frames: DataFrame, alpha: str = "a") -> DataFrame:
    """(clip, flicker): mean over neighbouring frames of the mean difference of their alphas; clips of one frame are missing."""
    return pairs(frames, alpha).groupBy("clip").agg(F.avg(mean_difference(alpha, f"before_{alpha}")).alias("flicker"))


MEASURED = "edge double, speckles long, holes long, residue double, cells long, score double"


def quality(frames: DataFrame, alpha: str = "a") -> DataFrame:
    """(clip, frames, edge, speckles, holes, residue, flicker, cells, overall_score): the quality report of each clip, from one pass over its frames and one over pairs."""
    each = per_frame(frames, lambda f: rules.measured(f[alpha]), MEASURED, alpha)
    total = each.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.avg("edge").alias("edge"), F.sum("speckles").alias("speckles"), F.sum("holes").alias("holes"), F.avg("residue").alias("residue"), F.sum("cells").alias("cells"))
    d = total.join(flicker(frames, alpha), "clip", "left").withColumn("flicker", F.coalesce("flicker", F.lit(0.0)))
    artifacts = F.least(F.lit(1.0), (F.col("speckles") + F.col("holes")) / F.col("cells"))
    penalty = 0.35 * F.col("edge") + 0.20 * F.col("residue") + 0.35 * F.col("flicker") + 0.50 * artifacts
    return d.withColumn("overall_score", F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), penalty)))


def regions(frames: DataFrame, alpha: str = "a", base: str | None = None) -> DataFrame:
    """Frames with the six region masks as arrays."""
    out = ", ".join(f"{k} array<boolean>" for k in REGIONS)
    return per_frame(frames, lambda f: rules.ownership(f.picture, f[alpha], f[base] if base else None), out, "r", "g", "b", alpha, *([base] if base else []), keep=tuple(frames.columns))


#: Low alphas of each risk's mask, and what its worst frame and its worst three may have.
LOW = {"hair": 0.08, "light": 0.35, "effect": 0.08}
RISKS = ("hair_edge_loss", "background_residue", "light_subject_loss", "transparent_effect_loss", "temporal_instability", "subject_misidentification")


def _shares(f: Frame) -> dict:
    a, own, p = rules.clip(f["a"]), f.own(), f.picture
    low = lambda mask, limit: float((a[mask] <= limit).mean()) if mask.any() else 0.0
    light = (p.brightness >= 180) & (p.chroma <= 35) & own["subject"]
    return {"hair": low(own["hair_edge"], LOW["hair"]), "light": low(light, LOW["light"]), "effect": low(own["transparent_effect"] | own["luminous_prop"], LOW["effect"]),
            "residue_share": float(own["background_residue"].mean()), "subject_share": float(own["subject"].mean()), "solid_share": float((a >= 0.70).mean())}


def level_of(score: Column) -> Column:
    return F.when(score >= 0.70, "fail").when(score >= 0.35, "warn").otherwise("pass")


def _stats(name: str) -> list[Column]:
    """mean, max, 95th percentile, min and mean of the three largest, by clip; the three largest are a bounded array."""
    top = F.slice(F.sort_array(F.collect_list(name), asc=False), 1, 3)
    return [F.avg(name).alias(f"{name}_mean"), F.max(name).alias(f"{name}_max"), F.expr(f"percentile({name}, 0.95)").alias(f"{name}_p95"), F.min(name).alias(f"{name}_min"),
            (F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)).alias(f"{name}_top3")]


def risks(owned: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """(clip, ord, risk, score, level, signals): six risks of each clip, in a fixed order, from frames with region masks (and a quality report, by default their own).

    One row a clip is made first and unpivoted then, so every source is read once.
    """
    report = quality(owned) if report is None else report
    shares = per_frame(owned, _shares, "hair double, light double, effect double, residue_share double, subject_share double, solid_share double", "a", "r", "g", "b", *REGIONS)
    names = ("hair", "light", "effect", "residue_share", "subject_share")
    wide = shares.groupBy("clip").agg(*[c for n in names for c in _stats(n)], F.avg("solid_share").alias("solid")).join(report, "clip")
    ratio = F.col("holes") / F.greatest("cells", F.lit(1))
    worst = lambda n, a, b: (F.col(f"{n}_max") / a, F.col(f"{n}_top3") / b)
    none = (F.col("subject_share_mean") == 0) & (F.col("solid") == 0)
    scores = [
        F.greatest(F.col("edge") / 0.12, ratio / 0.01, *worst("hair", 0.90, 0.50)), F.greatest(F.col("residue") / 0.10, *worst("residue_share", 0.20, 0.10)),
        F.greatest(*worst("light", 0.90, 0.50)), F.greatest(*worst("effect", 0.90, 0.50)), F.col("flicker") / 0.20,
        F.when(none, 0.0).when(F.col("subject_share_min") < 0.03, 0.60).otherwise(0.0)]

    def signals(*pairs_: tuple[str, Column]) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs_]), F.array(*[F.round(v, 6) for _, v in pairs_]))

    stats = lambda label, n, *of: [(label if k == "mean" else f"{label}_{'top3_mean' if k == 'top3' else k}", F.col(f"{n}_{k}")) for k in of]
    four = ("mean", "max", "p95", "top3")
    told = [
        signals(("quality_mean_edge_uncertainty", F.col("edge")), ("quality_hole_ratio", ratio), *stats("hair_low_alpha_ratio", "hair", *four)),
        signals(("quality_background_residue", F.col("residue")), *stats("region_background_residue_ratio", "residue_share", *four)),
        signals(*stats("light_low_alpha_ratio", "light", *four)), signals(*stats("effect_low_alpha_ratio", "effect", *four)),
        signals(("quality_temporal_flicker", F.col("flicker")), ("sequence_temporal_flicker", F.col("flicker"))),
        signals(*stats("subject_coverage_ratio", "subject_share", "mean", "min", "p95", "top3"), ("solid_alpha_ratio", F.col("solid")))]
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("risk"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)).alias("score"), t.alias("signals")) for k, (n, s, t) in enumerate(zip(RISKS, scores, told))])
    d = wide.select("clip", F.explode(rows).alias("x")).select("clip", "x.*")
    return d.select("clip", "ord", "risk", "score", level_of(F.col("score")).alias("level"), "signals")


# --- candidates: rows (clip, frame_idx, height, width, ord, candidate, a), beside frames with region masks


DECISIONS = "array<struct<region:string,candidate:string,score:double,pixels:bigint>>"
SELECTED = f"alpha array<double>, decisions {DECISIONS}, reasons array<string>, fallback string, selected_holes long, fallback_holes long, selected_score double, fallback_score double, selected_edge double, fallback_edge double"


def select(candidates: DataFrame, owned: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """The selected alpha of each frame with its decisions and why it was guarded, if it was.

    candidates: (clip, frame_idx, ord, candidate, a); owned: frames with region masks; scores: (clip, frame_idx, candidate,
    overall, and any of the regions), by default computed. A frame's few candidates are gathered in one row.
    """
    names = [] if scores is None else [r for r in REGIONS if r in scores.columns]
    one = [F.col("ord"), F.col("candidate"), F.col("a")]
    side = candidates
    if scores is not None:
        side = candidates.join(scores.select("clip", "frame_idx", "candidate", "overall", *names), ["clip", "frame_idx", "candidate"])
        one.append(F.struct("overall", *names).alias("given"))
    gathered = side.groupBy("clip", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(*one))).alias("of"))
    fields = [F.transform("of", lambda c: c["candidate"]).alias("names"), F.flatten(F.transform("of", lambda c: c["a"])).alias("values")]
    if scores is not None:
        fields += [F.transform("of", _field("given", k)).alias(f"given_{k}") for k in ("overall", *names)]
    d = owned.join(gathered, ["clip", "frame_idx"]).withColumns(dict(zip(["names", "values"] + ([f"given_{k}" for k in ("overall", *names)] if scores is not None else []), fields)))

    is_given = scores is not None

    def rule(f: Frame) -> dict:
        h, w = f.shape
        alphas = list(f.row["values"].reshape(-1, h, w))
        label = list(f.row["names"])
        given = [dict(zip(("overall", *names), map(float, x))) for x in zip(*[f.row[f"given_{k}"] for k in ("overall", *names)])] if is_given else None
        got = rules.selected(alphas, f.own(), given)
        return {"alpha": got["alpha"], "decisions": [{"region": r, "candidate": label[k], "score": s, "pixels": n} for r, k, s, n in got["decisions"]], "reasons": got["reasons"], "fallback": None if got["fallback"] is None else label[got["fallback"]],
                "selected_holes": got["chosen"]["holes"], "fallback_holes": got["safe"]["holes"], "selected_score": got["chosen"]["score"], "fallback_score": got["safe"]["score"], "selected_edge": got["chosen"]["edge"], "fallback_edge": got["safe"]["edge"]}

    need = [*REGIONS, "names", "values", *([f"given_{k}" for k in ("overall", *names)] if scores is not None else [])]
    return per_frame(d, rule, SELECTED, *need)


# --- over time


def over_clip(frames: DataFrame, rule: Callable[[list[np.ndarray]], list[np.ndarray]], alpha: str = "a") -> DataFrame:
    """A recurrence over the frames of a clip that treats each cell alone: (clip, frame_idx, height, width, alpha).

    Rows of the frame are dealt into tiles, so a group holds at most about TILE_VALUES values, however large or long the clip is (a single row of it at least).
    """
    kind = StructType([frames.schema["clip"], frames.schema["frame_idx"], frames.schema["height"], frames.schema["width"]])
    size = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("of"))
    d = frames.select(*KEYS, "height", "width", F.col(alpha).alias("v")).join(size, "clip")
    rows = F.greatest(F.lit(1), F.floor(F.lit(TILE_VALUES) / (F.col("of") * F.col("width")))).cast("int")
    d = d.withColumn("rows", rows).withColumn("tile", F.explode(F.expr("sequence(0, cast((height - 1) div rows as int))")))
    d = d.withColumn("v", F.expr("slice(v, tile * rows * width + 1, rows * width)")).select(*KEYS, "height", "width", "tile", "v")

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType([*kind, *StructType.fromDDL("tile int, v array<double>")]))

    def run(_, table):
        found = sorted((r for b in table.to_batches() for r in _rows(b)), key=lambda r: r["frame_idx"])
        values = [np.asarray(r["v"], float) for r in found]
        new = rule(values) if len(values) > 1 else values
        return pa.Table.from_batches([_batch([r | {"v": v} for r, v in zip(found, new)], out)])

    done = d.groupBy("clip", "tile").applyInArrow(run, StructType([*kind, *StructType.fromDDL("tile int, v array<double>")]))
    whole = done.groupBy(*KEYS, "height", "width").agg(F.array_sort(F.collect_list(F.struct("tile", "v"))).alias("t"))
    return whole.select(*KEYS, "height", "width", F.flatten(F.transform("t", lambda x: x["v"])).alias("alpha"))


def stabilise(frames: DataFrame, mode: str = "standard", strength: float = 0.5, alpha: str = "a") -> DataFrame:
    """(clip, frame_idx, height, width, alpha): 'fast' a moving average, 'standard' the adaptive one in both directions, 'high' along the movement of the pictures. Clips of one frame stay."""
    if mode == "fast":
        return over_clip(frames, lambda s: rules.ema(s, strength), alpha)
    if mode == "standard":
        return over_clip(frames, lambda s: rules.adaptive(s, strength=strength), alpha)
    if mode != "high":
        raise ValueError(f"unknown mode {mode}")
    return along_flow(frames, strength, alpha)


def along_flow(frames: DataFrame, strength: float = 0.5, alpha: str = "a") -> DataFrame:
    """Stabilised along the global movement. A frame depends on the one before as a whole, so a clip is one task's work, but as a stream of frames in order, of which one at a time is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType([frames.schema["clip"], frames.schema["frame_idx"], frames.schema["height"], frames.schema["width"], *StructType.fromDDL("alpha array<double>")])
    arrow = to_arrow_schema(kind)
    src = frames.select(*KEYS, "height", "width", "r", "g", "b", alpha).repartition("clip").sortWithinPartitions("clip", "frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip_, before, state = object(), None, None
        for batch in batches:
            for row in _rows(batch):
                f = Frame(row, row["height"], row["width"])
                if row["clip"] != clip_:
                    clip_, state = row["clip"], rules.clip(f[alpha])
                else:
                    state = rules.flow([state, f[alpha]], [before, f.picture], strength)[1]
                before = f.picture
                yield _batch([{k: row[k] for k in (*KEYS, "height", "width")} | {"alpha": state}], arrow)

    return src.mapInArrow(run, kind)



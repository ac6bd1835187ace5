"""Generators of candidate alphas: built-in keys and any model behind a function, alike.

A model is a factory that is called once in each Python worker and gives a function of a frame; a
recurrent one also gets its state of the frame before and returns the next. No weights are part of this
package; a model that isn't there, lacks its guidance or fails is a row of the skip table, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alphaloom.frames import api, rules
from alphaloom.frames.api import Frame

#: Why a candidate was skipped.
UNAVAILABLE, NO_GUIDANCE, DISABLED, FAILED = "model_unavailable", "guidance_missing", "disabled_by_config", "generation_failed"
#: Order in which engines are tried, for a clip and as a stand-in.
PRIORITY = ("gvm", "corridorkey", "rembg", "birefnet", "rvm")
FALLBACK = ("corridorkey", "rembg", "birefnet", "rvm")


@dataclass(frozen=True)
class Generator:
    """make() gives rule(frame) -> alpha, or, if recurrent, rule(frame, state) -> (alpha, state). Needs are columns of the frames."""

    name: str
    make: Callable[[], Callable] | None
    needs: tuple[str, ...] = ("r", "g", "b")
    guidance: str | None = None
    recurrent: bool = False
    enabled: bool = True


def checked(alpha, shape: tuple[int, int]) -> np.ndarray:
    """A model's output as an alpha of the frame's size: of a dict, pair or array, its channel axes dropped, divided by 255 if above 1, resized, clipped; ones where there is none."""
    if isinstance(alpha, dict):
        alpha = next((alpha[k] for k in ("alpha", "matte", "mask", "pha") if k in alpha), None)
    if isinstance(alpha, (tuple, list)):
        alpha = alpha[0] if len(alpha) else None
    if alpha is None:
        return np.ones(shape)
    a = np.squeeze(np.asarray(alpha, float))
    if a.ndim == 3:
        a = a[..., 0] if a.shape[2] <= 4 else a[0]
    if a.ndim != 2:
        raise ValueError(f"no alpha: shape {np.shape(alpha)}")
    if a.size and a.max() > 1:
        a = a / 255
    return rules.clip(a if a.shape == shape else rules.resized(a, *shape))


def traditional(mode: str = "green", **key) -> Generator:
    """The key of a screen, or of black."""
    if mode == "black_background" or mode == "black":
        return Generator("traditional", lambda: lambda f: rules.black_enhanced(f.picture, rules.black_base(f.picture))[0])
    return Generator("traditional", lambda: lambda f: rules.green_alpha(f.picture, **key))


_OUT = "ord int, candidate string, a array<double>, error string"


def _stateless(g: Generator, k: int, frames: DataFrame) -> DataFrame:
    made: dict[str, Callable] = {}

    def rule(f: Frame) -> dict:
        try:
            if "rule" not in made:
                made["rule"] = g.make()
            return {"ord": k, "candidate": g.name, "a": checked(made["rule"](f), f.shape), "error": None}
        except Exception as e:  # noqa: BLE001  whatever a model raises makes it a skipped candidate
            return {"ord": k, "candidate": g.name, "a": np.zeros(0), "error": f"{type(e).__name__}: {e}"}

    return api.per_frame(frames, rule, _OUT, *g.needs, *([g.guidance] if g.guidance else []))


def _recurrent(g: Generator, k: int, frames: DataFrame) -> DataFrame:
    """Frames of a clip in order, one at a time, as a frame needs the state of the one before; a clip is one task's work."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = ["clip", "frame_idx", "height", "width"]
    src = frames.select(*dict.fromkeys([*keep, *g.needs, *([g.guidance] if g.guidance else [])])).repartition("clip").sortWithinPartitions("clip", "frame_idx")
    kind = StructType([src.schema[c] for c in keep] + list(StructType.fromDDL(_OUT)))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, clip, state, error = None, object(), None, None
        for batch in batches:
            for row in api._rows(batch):
                f = Frame(row, row["height"], row["width"])
                if row["clip"] != clip:
                    clip, state, error = row["clip"], None, None  # a clip starts anew
                a = np.zeros(0)
                if error is None:
                    try:
                        rule = rule or g.make()
                        out, state = rule(f, state)
                        a = checked(out, f.shape)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                yield api._batch([{c: row[c] for c in keep} | {"ord": k, "candidate": g.name, "a": a, "error": error}], arrow)

    return src.mapInArrow(run, kind)


def generate(frames: DataFrame, generators: list[Generator]) -> tuple[DataFrame, DataFrame]:
    """(candidates, skipped): rows (clip, frame_idx, height, width, ord, candidate, a) of the generators that worked on all frames of a clip, and (clip, name, reason, message) of the others."""
    clips = frames.select("clip").distinct()
    made, skipped = None, None

    def skip(name: str, reason: str, message: str) -> DataFrame:
        return clips.select("clip", F.lit(name).alias("name"), F.lit(reason).alias("reason"), F.lit(message).alias("message"))

    for k, g in enumerate(generators):
        if not g.enabled:
            row = skip(g.name, DISABLED, f"{g.name} is disabled")
        elif g.make is None:
            row = skip(g.name, UNAVAILABLE, f"{g.name} is not available")
        elif g.guidance and g.guidance not in frames.columns:
            row = skip(g.name, NO_GUIDANCE, f"{g.name} needs {g.guidance}")
        else:
            out = (_recurrent if g.recurrent else _stateless)(g, k, frames)
            made, row = (out if made is None else made.unionByName(out)), None
        if row is not None:
            skipped = row if skipped is None else skipped.unionByName(row)
    if made is None:
        raise RuntimeError("no candidates were generated")
    # A clip's candidate with an error in any frame is skipped as a whole.
    broken = made.where("error is not null").groupBy("clip", F.col("candidate").alias("name")).agg(F.min("error").alias("message"))
    failed = broken.select("clip", "name", F.lit(FAILED).alias("reason"), "message")
    good = made.join(broken.select("clip", F.col("name").alias("candidate")), ["clip", "candidate"], "left_anti").drop("error")
    return good, failed if skipped is None else skipped.unionByName(failed)


def first_ready(ready: DataFrame, *keys: str, order: tuple[str, ...] = PRIORITY, exclude: str | None = None) -> DataFrame:
    """(keys, engine): the requested engine, else the first ready one in order, of rows (keys, engine, ready, requested)."""
    names = F.array(*[F.lit(n) for n in order if n != exclude])
    rank = F.array_position(names, F.col("engine"))
    able = F.col("ready") & (rank > 0)
    asked = F.max(F.when(F.col("requested") == F.col("engine"), F.col("engine")))
    best = F.min_by(F.when(able, F.col("engine")), F.when(able, rank))
    return ready.groupBy(*keys).agg(asked.alias("asked"), best.alias("best"), F.max("requested").alias("requested")).select(
        *keys, F.when(F.col("requested").isNull() | (F.col("requested") == "auto"), F.col("best")).otherwise(F.col("asked")).alias("engine"))

"""Any query over a caller's own tables.

    from alphaloom import api
    fixed = api.run("p18_green_despill", spark, pixels=my_pixels)
    report = api.run("a01_alpha_quality", spark, frames=my_frames)

Tables that can be bound, in place of the views of the test data: pixels (clip, frame_idx, y, x, r, g, b, a, ai), frames
(clip, frame_idx, height, width, and these values as arrays), metrics, baseline and jobs, with the columns that
alphaloom.plans.views gives them; and sf_dir for queries over tables. alphaloom.frames.api has the same rules with all their parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alphaloom.plans import registry
from alphaloom.plans.relation import BOUND


def run(name: str, spark: SparkSession, sf_dir: str | None = None, **tables: DataFrame) -> DataFrame:
    """The named query's lazy result over the bound tables."""
    if unknown := set(tables) - {"pixels", "frames", "metrics", "baseline", "jobs"}:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    if not {"pixels", "frames"}.isdisjoint(tables):
        wanted = "clip frame_idx y x r g b a ai" if "pixels" in tables else "clip frame_idx height width r g b a ai"
        if missing := set(wanted.split()) - set(tables["pixels" if "pixels" in tables else "frames"].columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
    token = BOUND.set(tables)
    try:
        return registry.queries()[name](spark, sf_dir)
    finally:
        BOUND.reset(token)

"""Reports and rules: flattening, threshold gates, names, ordered rules, text and JSON output, format detection."""

from __future__ import annotations

from alphaloom.operators.aggregates import CLASSIFIED
from alphaloom.operators.points import rnd, shown
from alphaloom.plans.relation import Relation, table
from alphaloom.plans.views import JOBS


def over(metric: str, name: str, limit: float) -> str:
    return f"case when {metric} > {limit!r}e0 then concat('{name} ', format_string('%.3f', {metric}), ' above maximum {limit:.3f}') end"


SUFFIX = "lower(regexp_extract(path, '([.][^./]+)$', 1))"
#: Suffixes of videos and images.
VIDEO, IMAGE = "('.mp4', '.mov', '.avi', '.mkv', '.webm')", "('.png', '.jpg', '.jpeg', '.exr', '.bmp', '.tif', '.tiff', '.webp')"
PATHS = table("part", "p_partkey", "p_name", "p_type").select("p_partkey", path="concat('/assets/', replace(p_type, ' ', '_'), '/clip', cast(p_partkey as string), (case when p_partkey % 6 = 0 then '.MP4' when p_partkey % 6 = 1 then '.png' when p_partkey % 6 = 2 then '.Exr' when p_partkey % 6 = 3 then '.txt' when p_partkey % 6 = 4 then '' else '.JPG' end))")
MESSAGES = table("documents", "doc_id", "text").select("doc_id", msg="lower(substring(text, 1, 200))")
URLS = table("pages", "page_id", "url")

OPS: dict[str, Relation] = {
    "x06_sanitize_name": URLS.select("page_id", name=("coalesce(nullif(trim(both '_.' from regexp_replace(url, '[<>:\"/\\\\\\\\|?*\\\\s]+', '_')), ''), 'output')", "coalesce(nullif(trim(regexp_replace(url, '[<>:\"/\\\\|?*\\s]+', '_', 'g'), '_.'), ''), 'output')")),
    "x17_relative_path": PATHS.select("p_partkey", shown="(case when path like '/assets/%' then substring(path, 9) else path end)"),
    "x20_result_mapping": JOBS.select("job_id", frames="coalesce(nullif(done, 0), total)", elapsed=rnd("coalesce(seconds, 0e0)")),
    "x21_path_containment": PATHS.select("p_partkey", inside="(path like '/assets/%' and path not like '%/../%')"),
    "x22_effective_mode": CLASSIFIED.select("clip", mode="(case when background = 'unknown' and green >= black then 'green' when background = 'unknown' then 'black' else background end)"),
    "s01_input_kind_detect": PATHS.select("p_partkey", kind=f"(case when {SUFFIX} = '' then 'sequence' when {SUFFIX} in {VIDEO} then 'video' when {SUFFIX} in {IMAGE} then 'image' else 'unsupported' end)"),
    "s02_suffix_predicates": PATHS.select("p_partkey", is_video=f"({SUFFIX} in {VIDEO})", is_image=f"({SUFFIX} in {IMAGE})"),
    "s07_decode_dispatch": PATHS.select("p_partkey", reader=f"(case when {SUFFIX} = '' then 'sequence_scan' when {SUFFIX} in {VIDEO} then 'video_scan' when {SUFFIX} in {IMAGE} then 'image_scan' else 'none' end)"),
}

"""Asset manifests: names and background modes from paths, strict reading with defaults, and the merge of generated with existing samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of videos, images and assets.
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".webm")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".exr")
ASSET = (".exr", ".jpeg", ".jpg", ".mov", ".mp4", ".png", ".webm")
#: Ceilings of risks by background mode.
CEILINGS = {"black_background": {"background_residue": 0.2, "transparent_effect_loss": 0.5}, "green_screen": {"background_residue": 0.2, "hair_edge_loss": 0.5}, "auto": {"background_residue": 0.25, "hair_edge_loss": 0.6}}
#: Values of the two modes; names in lower case mean the same.
BACKGROUNDS = {"auto": "auto", "green_screen": "green_screen", "black_background": "black_background", "unknown": "unknown"}
QUALITIES = ("fast", "standard", "high")

MANIFEST = "array<struct<name:string,input_path:string,background_mode:string,quality_mode:string,candidate_models:array<string>,risk_ceilings:map<string,double>,expected_alpha_path:string,alpha_mae_ceiling:double,alpha_mse_ceiling:double,required_temporal_models:array<string>,region_expectations:struct<required_regions:array<string>,min_region_ratios:map<string,double>>>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?<=.)\.[^.]*$", "")


def background_of(path: Column) -> Column:
    """Black before green before auto, by the words of a path."""
    low = F.lower(path)
    return F.when(low.contains("black"), "black_background").when(low.contains("green"), "green_screen").otherwise("auto")


def name_of(path: Column) -> Column:
    """Folder and stem, in lower case; the stem alone at the root."""
    folder = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    low = F.lower(stem(path))
    return F.when(folder.isin("assets", ".", ""), low).otherwise(F.concat_ws("_", folder, low))


def ceilings(mode: Column) -> Column:
    out = F.lit(None)
    for k, v in CEILINGS.items():
        out = F.when(mode == k, F.create_map(*[F.lit(x) for pair in v.items() for x in pair])).otherwise(out)
    return out


def generated(assets: DataFrame) -> DataFrame:
    """Sample rows for (path) of assets, with the defaults of a new sample; other files are left out."""
    d = assets.where(suffix(F.col("path")).isin(*ASSET))
    mode = background_of(F.col("path"))
    return d.select(name_of(F.col("path")).alias("name"), F.col("path").alias("input_path"), mode.alias("background_mode"), F.lit("standard").alias("quality_mode"), F.array(F.lit("traditional")).alias("candidate_models"), ceilings(mode).alias("risk_ceilings"))


def merged(made: DataFrame, existing: DataFrame) -> DataFrame:
    """Full join by input path: existing samples keep their values and gain missing ones, new ones are added, unmatched ones stay."""
    keys = [c for c in made.columns if c != "input_path"]
    a, b = made.withColumnsRenamed({k: f"g_{k}" for k in keys}).withColumn("g_", F.lit(True)), existing.withColumnsRenamed({k: f"e_{k}" for k in keys}).withColumn("e_", F.lit(True))
    d = a.join(b, "input_path", "full_outer")
    gained = F.lit(False)
    for k in keys:
        gained = gained | (F.col(f"e_{k}").isNull() & F.col(f"g_{k}").isNotNull())
    change = F.when(F.col("e_").isNull(), "added").when(F.col("g_").isNotNull() & gained, "updated").otherwise("kept")
    return d.select("input_path", *[F.coalesce(f"e_{k}", f"g_{k}").alias(k) for k in keys], change.alias("change"))


def coerced(value: Column, known: dict[str, str] | tuple[str, ...], what: str) -> Column:
    """A mode by its value or its name in lower case; anything else is an error."""
    names = known if isinstance(known, dict) else {k: k for k in known}
    out = F.raise_error(F.concat(F.lit(f"Unsupported {what}: "), F.coalesce(value, F.lit("null"))))
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def samples(raw: DataFrame) -> DataFrame:
    """Sample rows of manifest documents (raw), with defaults; an error where one has another shape or lacks what it needs."""
    d = raw.withColumn("doc_", F.expr("parse_json(raw)"))
    ok = lambda cond, text: F.when(cond, F.lit(True)).otherwise(F.raise_error(F.lit(text)))
    d = d.where(ok(F.expr("schema_of_variant(doc_) like 'OBJECT%'"), "manifest top-level JSON must be an object"))
    listed = F.expr("variant_get(doc_, '$.samples', 'variant')")
    d = d.withColumn("of_", listed).where(ok(F.col("of_").isNull() | F.expr("schema_of_variant(of_) like 'ARRAY%'"), "manifest samples must be a list"))
    rows = F.expr(f"explode(coalesce(variant_get(of_, '$', '{MANIFEST}'), array()))")
    d = d.select(*[c for c in raw.columns if c != "raw"], rows.alias("s_"))
    d = d.where(ok(F.col("s_").isNotNull(), "manifest sample must be an object"))
    need = lambda k: F.coalesce(F.col(f"s_.{k}"), F.raise_error(F.lit(f"manifest sample without {k}"))).alias(k)
    return d.select(*[c for c in raw.columns if c != "raw"], need("name"), need("input_path"), need("background_mode"), F.coalesce("s_.quality_mode", F.lit("standard")).alias("quality_mode"),
                    F.coalesce("s_.candidate_models", F.array().cast("array<string>")).alias("candidate_models"), F.coalesce("s_.risk_ceilings", F.expr("cast(map() as map<string,double>)")).alias("risk_ceilings"),
                    "s_.expected_alpha_path", "s_.alpha_mae_ceiling", "s_.alpha_mse_ceiling", F.coalesce("s_.required_temporal_models", F.array().cast("array<string>")).alias("required_temporal_models"), "s_.region_expectations")


#: The six regions.
REGIONS = ("subject", "hair_edge", "luminous_prop", "transparent_effect", "background_residue", "uncertain_edge")


def expectation_failures(counts: DataFrame, expectations: DataFrame) -> DataFrame:
    """Regions that a clip should have, against what it has.

    counts: (clip, cells, and one column of cells a region); expectations: (clip, required array<string>, min_ratios map<string,double>).
    An unknown region is an error. Clips without expectations have no failures.
    """
    ratio = F.create_map(*[x for r in REGIONS for x in (F.lit(r), F.round(F.col(r) / F.greatest("cells", F.lit(1)), 6))])
    pixels = F.create_map(*[x for r in REGIONS for x in (F.lit(r), F.col(r))])
    d = counts.join(expectations, "clip", "left").withColumn("pixels_", pixels).withColumn("ratios_", ratio)
    known = lambda m, r: F.coalesce(F.col(m)[r], F.raise_error(F.concat(F.lit("Unsupported region: "), r)))
    missing = F.transform(F.filter("required", lambda r: known("pixels_", r) <= 0), lambda r: F.concat(F.lit("required_region "), r, F.lit(" missing")))
    under = F.transform(F.filter(F.array_sort(F.map_entries("min_ratios")), lambda e: known("ratios_", e["key"]) < e["value"]),
                        lambda e: F.concat(F.lit("region_ratio "), e["key"], F.lit(" "), F.format_string("%.6f", F.col("ratios_")[e["key"]]), F.lit(" below minimum "), F.format_string("%.6f", e["value"])))
    none = F.array().cast("array<string>")
    return d.withColumn("failures", F.concat(F.coalesce(missing, none), F.coalesce(under, none))).drop("pixels_", "ratios_")

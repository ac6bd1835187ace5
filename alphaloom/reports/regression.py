"""Quality regression over processing reports: reading, flattening, threshold and baseline gates, and the run's documents.

Reports are rows (path, raw) of whole JSON texts. A report that can't be read, or isn't an object, is a
failing sample, not an error; a root without reports is one failing sample.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "processing_report.json"


@dataclass(frozen=True)
class Thresholds:
    """The default gates."""

    min_overall_score: float = 0.80
    max_mean_edge_uncertainty: float = 0.08
    max_hole_pixels: int = 100
    max_background_residue: float = 0.02
    max_temporal_flicker: float = 0.08
    max_edge_temporal_flicker: float = 0.08
    max_transparent_temporal_flicker: float = 0.08
    max_max_frame_delta: float = 0.12
    max_hair_low_alpha_ratio: float = 0.30
    max_effect_low_alpha_ratio: float = 0.30
    max_score_drop: float = 0.05
    max_p0_risk_score_increase: float = 0.20


#: Metrics of the quality section, and which of them are whole numbers.
QUALITY = ("overall_score", "mean_edge_uncertainty", "speckle_pixels", "hole_pixels", "background_residue", "temporal_flicker", "edge_temporal_flicker", "transparent_temporal_flicker", "max_frame_delta")
WHOLE = ("speckle_pixels", "hole_pixels")


def discover(files: DataFrame, root: str) -> DataFrame:
    """The report files among (path, ...) rows: all named like one below root, or the single file that root names."""
    below = F.col("path").startswith(root.rstrip("/") + "/") & F.col("path").endswith("/" + REPORT)
    return files.where((F.col("path") == root) | below)


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of all reports below root; content of other files is never read."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", REPORT).option("wholetext", True).text(root).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def sample_name(path: Column, input_path: Column) -> Column:
    """Stem of the job's input, else the report's folder, else the report's own stem."""
    stem = lambda p: F.regexp_replace(F.regexp_extract(p, r"([^/]+)/*$", 1), r"(?<=.)\.[^.]*$", "")
    folder = F.when(F.regexp_extract(path, r"([^/]+)$", 1) == REPORT, F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.coalesce(F.nullif(stem(F.coalesce(input_path, F.lit(""))), F.lit("")), F.nullif(folder, F.lit("")), stem(path))


def number(report: str, path: str, whole: bool = False) -> Column:
    """A number (or a text of one) in a VARIANT; 0 where there is none. Whole numbers are cut off, not rounded."""
    v = F.expr(f"coalesce(try_variant_get({report}, '{path}', 'double'), 0e0)")
    return v.cast("long") if whole else v


def fixed(v: Column, digits: int = 3) -> Column:
    """A number with so many decimals, as C and Python write it: its exact value is rounded, half-way ones to the even digit (format_string rounds its shortest text upwards)."""
    tie = float(f"5e-{digits + 1}")  # the one value that Java's DecimalFormat takes for half-way even if it isn't
    finite = F.call_function("format_number", v, F.lit("0." + "0" * digits))
    return F.when(F.abs(v) == tie, F.concat(F.when(v < 0, "-").otherwise(""), F.lit(f"{tie:.{digits}f}"))).when(F.isnan(v) | (F.abs(v) == float("inf")), F.format_string(f"%.{digits}f", v)).otherwise(finite)


def parsed(raw: DataFrame) -> DataFrame:
    """raw rows with the report as a VARIANT, its sample's name, and what is wrong with it, if anything."""
    d = raw.withColumn("report", F.expr("try_parse_json(raw)"))
    is_object = F.coalesce(F.expr("schema_of_variant(report) like 'OBJECT%'"), F.lit(False))
    d = d.withColumn("failure", F.when(F.col("report").isNull(), "invalid processing report: malformed JSON").when(~is_object, "invalid processing report: top-level JSON must be an object"))
    d = d.withColumn("report", F.when(is_object, F.col("report")))
    return d.withColumn("sample", sample_name(F.col("path"), F.expr("try_variant_get(report, '$.job.input_path', 'string')")))


_NUMERIC = "(schema_of_variant({v}) in ('BIGINT', 'DOUBLE') or schema_of_variant({v}) like 'DECIMAL%')"


def flattened(d: DataFrame) -> DataFrame:
    """Parsed rows with their metrics: the quality section's, and maps of risk scores, levels and signals under dotted names."""
    for k in QUALITY:
        d = d.withColumn(k, number("report", f"$.quality.{k}", k in WHOLE))
    d = d.withColumn("risks_", F.expr("coalesce(try_variant_get(report, '$.p0_risks', 'map<string,variant>'), cast(map() as map<string,variant>))"))
    d = d.withColumn("risks_", F.expr("filter(transform(array_sort(map_keys(risks_)), k -> struct(k as risk, risks_[k] as v)), e -> schema_of_variant(e.v) like 'OBJECT%')"))
    d = d.withColumn("risk_scores", F.expr("map_from_entries(transform(risks_, e -> struct(concat('p0_risk.', e.risk, '.score'), coalesce(try_variant_get(e.v, '$.score', 'double'), 0e0))))"))
    d = d.withColumn("risk_levels", F.expr("map_from_entries(transform(risks_, e -> struct(concat('p0_risk.', e.risk, '.level'), coalesce(try_variant_get(e.v, '$.level', 'string'), 'pass'))))"))
    signals = "map_entries(coalesce(try_variant_get(e.v, '$.signals', 'map<string,variant>'), cast(map() as map<string,variant>)))"
    told = f"transform(filter({signals}, s -> {_NUMERIC.format(v='s.value')}), s -> struct(concat('p0_risk.', e.risk, '.signal.', s.key), try_variant_get(s.value, '$', 'double')))"
    d = d.withColumn("risk_signals", F.expr(f"map_from_entries(flatten(transform(risks_, e -> {told})))"))
    d = d.withColumn("selection_available", F.expr("coalesce(try_variant_get(report, '$.quality_selection.available', 'boolean'), false)"))
    return d.withColumn("candidate_count", number("report", "$.quality_selection.candidate_count", True)).drop("risks_")


def metric_rows(d: DataFrame) -> DataFrame:
    """(path, sample, metric, value): all numeric metrics of flattened rows, one a row."""
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in QUALITY]), F.array(*[F.col(k).cast("double") for k in QUALITY]))
    return d.select("path", "sample", F.explode(F.map_concat(own, "risk_scores", "risk_signals")).alias("metric", "value"))


def baseline(raw: DataFrame) -> DataFrame:
    """(sample, metric, value) of baseline documents (raw): bare or under 'samples'; what isn't a map of numbers is left out."""
    root = F.expr("try_variant_get(try_parse_json(raw), '$', 'map<string,variant>')")
    d = raw.select(root.alias("m")).select(F.expr("coalesce(try_variant_get(m['samples'], '$', 'map<string,variant>'), case when m['samples'] is null then m end)").alias("m"))
    d = d.select(F.explode("m").alias("sample", "v")).where("schema_of_variant(v) like 'OBJECT%'")
    d = d.select("sample", F.expr("explode(try_variant_get(v, '$', 'map<string,variant>')) as (metric, x)"))
    return d.where(_NUMERIC.format(v="x")).select("sample", "metric", F.expr("try_variant_get(x, '$', 'double')").alias("value"))


def _above(column: str, name: str, limit: float) -> Column:
    v = F.col(column) if "." not in column else F.coalesce(F.col("risk_signals")[column], F.lit(0.0))
    return F.when(v > limit, F.concat(F.lit(f"{name} "), fixed(v), F.lit(f" above maximum {limit:.3f}")))


def failures(t: Thresholds) -> Column:
    """The ordered failure texts of a flattened row with its baseline (a map of metrics)."""
    checks = [
        F.col("failure"),
        F.when(F.col("overall_score") < t.min_overall_score, F.concat(F.lit("overall_score "), fixed(F.col("overall_score")), F.lit(f" below minimum {t.min_overall_score:.3f}"))),
        _above("mean_edge_uncertainty", "mean_edge_uncertainty", t.max_mean_edge_uncertainty),
        F.when(F.col("hole_pixels") > t.max_hole_pixels, F.concat(F.lit("hole_pixels "), F.col("hole_pixels").cast("string"), F.lit(f" above maximum {t.max_hole_pixels}"))),
        _above("background_residue", "background_residue", t.max_background_residue), _above("temporal_flicker", "temporal_flicker", t.max_temporal_flicker),
        _above("edge_temporal_flicker", "edge_temporal_flicker", t.max_edge_temporal_flicker), _above("transparent_temporal_flicker", "transparent_temporal_flicker", t.max_transparent_temporal_flicker),
        _above("max_frame_delta", "max_frame_delta", t.max_max_frame_delta),
        _above("p0_risk.hair_edge_loss.signal.hair_low_alpha_ratio", "hair_low_alpha_ratio", t.max_hair_low_alpha_ratio),
        _above("p0_risk.transparent_effect_loss.signal.effect_low_alpha_ratio", "effect_low_alpha_ratio", t.max_effect_low_alpha_ratio),
        F.when(F.col("selection_available") & (F.col("candidate_count") <= 0), "quality selection enabled but no candidates available")]
    base = F.col("base")["overall_score"]
    drop = base - F.col("overall_score")
    checks.append(F.when(drop > t.max_score_drop, F.concat(F.lit("overall_score dropped "), fixed(drop), F.lit(" from baseline "), fixed(base))))
    risk = lambda key, end: F.regexp_replace(F.regexp_replace(key, r"^p0_risk\.", ""), rf"\.{end}$", "")
    failed = F.transform(F.filter(F.array_sort(F.map_entries("risk_levels")), lambda e: e["value"] == "fail"), lambda e: F.concat(F.lit("p0 "), risk(e["key"], "level"), F.lit(" level fail")))
    risen = F.filter(F.array_sort(F.map_entries("risk_scores")), lambda e: e["value"] - F.col("base")[e["key"]] > t.max_p0_risk_score_increase)
    rise = F.transform(risen, lambda e: F.concat(F.lit("p0 "), risk(e["key"], "score"), F.lit(" risk increased "), fixed(e["value"] - F.col("base")[e["key"]]), F.lit(" from baseline "), fixed(F.col("base")[e["key"]])))
    # A report that couldn't be read fails by that alone.
    return F.when(F.col("failure").isNotNull(), F.array("failure")).otherwise(F.concat(F.array_compact(F.array(*checks)), failed, rise))


def evaluate(raw: DataFrame, base: DataFrame | None = None, thresholds: Thresholds = Thresholds(), root: str = "") -> DataFrame:
    """One row a report (path, sample, metrics, base, failures, passed); one failing row if there is no report at all."""
    spark = raw.sparkSession
    d = flattened(parsed(raw))
    missing = spark.createDataFrame([(f"{root.rstrip('/')}/{REPORT}".lstrip("/") if not root.startswith("/") else f"{root.rstrip('/')}/{REPORT}", "no processing_report.json files found")], "path string, failure string")
    any_ = raw.select(F.lit(True).alias("any_")).limit(1)
    sentinel = missing.join(any_, F.lit(True), "left").where("any_ is null").select("path", "failure", F.lit(None).cast("string").alias("raw"))
    lone = flattened(parsed(sentinel.select("path", "raw")).drop("failure").join(sentinel.select("path", "failure"), "path"))
    d = d.unionByName(lone.select(d.columns))
    if base is None:
        d = d.withColumn("base", F.expr("cast(map() as map<string,double>)"))
    else:
        maps = base.groupBy(F.col("sample").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("base"))
        d = d.join(maps, F.col("sample") == F.col("of"), "left").drop("of").withColumn("base", F.coalesce("base", F.expr("cast(map() as map<string,double>)")))
    d = d.withColumn("failures", failures(thresholds))
    return d.withColumn("passed", F.size("failures") == 0)


def summary(d: DataFrame) -> DataFrame:
    """(total, failed, passed, status) of a run."""
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("passed").alias("passed_count")).withColumn("status", F.when(F.col("failed") == 0, "pass").otherwise("fail"))


def markdown_rows(d: DataFrame) -> DataFrame:
    """(sample, line): one table line a sample."""
    line = F.concat(F.lit("| "), F.col("sample"), F.lit(" | "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" | "), fixed(F.col("overall_score")), F.lit(" | "),
                    F.col("hole_pixels").cast("string"), F.lit(" | "), F.array_join("failures", "<br>"), F.lit(" |"))
    return d.select("path", "sample", line.alias("line"))


def markdown(d: DataFrame) -> DataFrame:
    """(document): the whole run as Markdown; its size is that of the run, so it is one text by design."""
    head = summary(d).select(F.concat_ws("\n", F.lit("# Quality Regression Report"), F.lit(""), F.concat(F.lit("Status: "), F.upper("status")), F.concat(F.lit("Samples: "), F.col("total")), F.concat(F.lit("Passed: "), F.col("passed_count")),
                                         F.concat(F.lit("Failed: "), F.col("failed")), F.lit(""), F.lit("| Sample | Status | Overall | Holes | Failures |"), F.lit("| --- | --- | ---: | ---: | --- |")).alias("head"))
    body = markdown_rows(d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return head.join(body).select(F.concat("head", F.lit("\n"), "body", F.lit("\n")).alias("document"))


def sample_rows(d: DataFrame) -> DataFrame:
    """(path, sample, status, document): each sample's result as JSON."""
    row = F.struct(F.col("sample").alias("sample_name"), F.col("path").alias("report_path"), F.when(F.col("passed"), "pass").otherwise("fail").alias("status"),
                   F.struct(*[F.col(k) for k in QUALITY]).alias("metrics"), F.col("base").alias("baseline_metrics"), "failures")
    return d.select("path", "sample", F.when(F.col("passed"), "pass").otherwise("fail").alias("status"), F.to_json(row).alias("document"))


def document(d: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(document): summary, thresholds and samples of a run as one JSON text."""
    limits = F.struct(*[F.lit(getattr(thresholds, f.name)).alias(f.name) for f in fields(thresholds)])
    rows = sample_rows(d).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "document"))), lambda x: x["document"]).alias("samples"))
    told = summary(d).select(F.to_json(F.struct("status", F.col("total").alias("total_count"), "passed_count", F.col("failed").alias("failed_count"))).alias("summary"))
    return told.join(rows).select(F.concat(F.lit('{"summary":'), "summary", F.lit(',"thresholds":'), F.to_json(limits), F.lit(',"samples":['), F.array_join("samples", ","), F.lit("]}")).alias("document"))


def main(argv: list[str] | None = None) -> int:
    """Command: gate the reports below a folder; writes JSON and Markdown where asked, and its exit code tells whether all passed."""
    import argparse

    from alphaloom.session import local_session

    p = argparse.ArgumentParser(prog="alphaloom-regression")
    p.add_argument("--reports", required=True)
    p.add_argument("--baseline")
    p.add_argument("--json")
    p.add_argument("--markdown")
    for f in fields(Thresholds):
        p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    args = p.parse_args(argv)
    spark = local_session("*", "regression")
    limits = Thresholds(**{f.name: getattr(args, f.name) for f in fields(Thresholds)})
    base = baseline(spark.read.option("wholetext", True).text(args.baseline).withColumnRenamed("value", "raw")) if args.baseline else None
    run = evaluate(read_raw(spark, args.reports), base, limits, args.reports).cache()
    for path, made in ((args.json, lambda: document(run, limits)), (args.markdown, lambda: markdown(run))):
        if path:
            made().coalesce(1).write.mode("overwrite").text(path)
    failed = summary(run).first()["failed"]
    for r in run.where("not passed").select("sample", "failures").orderBy("path").collect():
        print(r["sample"], *r["failures"], sep="\n  ")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

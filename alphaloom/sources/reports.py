"""Report files: recursive discovery and tolerant reading (a bad file becomes a failing row, not an error)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, root: str, name: str = "processing_report.json") -> DataFrame:
    """(path, sample, report, failure): every report below root, as a VARIANT, or what is wrong with it."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).text(root).select(
        F.input_file_name().alias("path"), F.col("value").alias("raw"))
    parsed = raw.withColumn("report", F.expr("try_parse_json(raw)"))
    is_object = F.coalesce(F.expr("schema_of_variant(report) like 'OBJECT%'"), F.lit(False))
    stem = F.regexp_extract(F.expr("try_variant_get(report, '$.job.input_path', 'string')"), r"([^/]+?)(?:[.][^./]*)?$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return parsed.select(
        "path", F.coalesce(F.nullif(stem, F.lit("")), folder).alias("sample"), F.when(is_object, F.col("report")).alias("report"),
        F.when(F.col("report").isNull(), "report is not valid JSON").when(~is_object, "report is not an object").alias("failure"))

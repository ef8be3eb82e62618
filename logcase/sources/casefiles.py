"""Case files and ground truth as JSON documents.

A case file is one, possibly pretty-printed, document per file
(``layout="file"``). Many cases travel as one document per line
(``layout="lines"``), which is what ``write_cases`` emits: each line is
``{"case_id": ..., "case": {...}}``, so that ids survive the round trip.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.functions.jsonvals import as_object, strict_value
from logcase.operators.casefile import parse_cases, parse_ground_truth
from logcase.sources.discover import normalise_path


def read_documents(spark: SparkSession, paths, whole: bool = True) -> DataFrame:
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.text(list(paths), wholetext=whole).select(
        normalise_path(F.col("_metadata.file_path"), encoded=True).alias("path"), F.col("value").alias("text"))


def read_cases(spark: SparkSession, paths, layout: str = "file") -> DataFrame:
    """(path, case_id, text, doc, case). ``layout="file"``: one document per
    file, its id is the file name without extensions. ``layout="lines"``: one
    ``write_cases`` line per case; a line that is no such envelope is kept as
    a case without an id, whose validation then fails."""
    if layout == "file":
        d = read_documents(spark, paths)
        return parse_cases(d.withColumn("case_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)*$", 1)))
    if layout != "lines":
        raise ValueError(f"unknown layout {layout!r}")
    d = read_documents(spark, paths, whole=False).where(F.trim("text") != "").withColumn("line", as_object(strict_value(F.col("text"))))
    is_envelope = F.array_sort(F.map_keys("line")) == F.array(F.lit("case"), F.lit("case_id"))
    text = F.when(is_envelope, F.to_json(F.col("line").getItem("case"))).otherwise(F.col("text"))
    case_id = F.when(is_envelope, F.try_variant_get(F.col("line").getItem("case_id"), "$", "string"))
    return parse_cases(d.select("path", case_id.alias("case_id"), text.alias("text")))


def read_ground_truth(spark: SparkSession, paths) -> DataFrame:
    d = read_documents(spark, paths)
    g = parse_ground_truth(d)
    return g.withColumn("incident_id", F.col("gt.incident_id"))


def write_cases(cases: DataFrame, path: str, mode: str = "overwrite", id_col: str = "case_id") -> None:
    """One line per case: its id and its document (the typed view, so defaults
    are filled in). Read back with ``read_cases(layout="lines")``."""
    cases.select(F.to_json(F.struct(F.col(id_col).cast("string").alias("case_id"), F.col("case").alias("case"))).alias("value")) \
        .write.mode(mode).text(path)

"""Log files written from the log view, for end-to-end ingest checks.

Each log-view row becomes one line of ``part-<k>.jsonl`` at its own line
number; the files are gzip text under the shared scratch folder. Every file
is written by one task (hash-partitioned by name) and its lines in order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.session import scratch_dir

FILE_NAME_RE = r"name=([^/]+)/"


def write_log_files(view: DataFrame, line: Column, name: str = "logs") -> str:
    path = scratch_dir(view.sparkSession, name)
    df = view.select(F.regexp_replace("file", "^logs/", "").alias("name"), "line", line.alias("value"))
    # no fixed number: in as many partitions as there are files, hashes put several large files into one
    (df.repartition("name").sortWithinPartitions("name", "line").select("name", "value")
       .write.partitionBy("name").option("compression", "gzip").text(path))
    return path


def logical_name(file: Column) -> Column:
    """``.../name=part-3.jsonl/part-0000-….txt.gz`` -> ``part-3.jsonl``."""
    return F.regexp_extract(file, FILE_NAME_RE, 1)

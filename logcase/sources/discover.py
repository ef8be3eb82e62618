"""Which files to ingest.

A directory contributes every file below it whose suffix is a log suffix; a
file named explicitly is taken whatever its suffix; a path that does not
exist is dropped. A file that is given twice, or by its folder and by itself,
counts once. Listing runs through Spark's file index (parallel for large
trees); only file metadata is read here. Names may hold any character: given
paths are literal, never globs, and results carry names as they are on disk.
"""
from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes picked up inside a directory.
LOG_SUFFIXES = (".log", ".jsonl", ".ndjson", ".gz")
LOG_GLOB = "*.{" + ",".join(s.lstrip(".") for s in LOG_SUFFIXES) + "}"


@dataclass(frozen=True)
class LogSources:
    dirs: tuple[str, ...]
    files: tuple[str, ...]


def _look_up(spark: SparkSession, path: str) -> tuple[str | None, str]:
    """'dir', 'file' or None, and the full path; one file-system call."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(as_literal(path)))
    if not found:
        return None, path
    return ("dir" if found[0].isDirectory() else "file"), found[0].getPath().toString()


def as_literal(path: str) -> str:
    """``path`` with its glob characters escaped, for readers that expand globs."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def split_paths(spark: SparkSession, paths: list[str] | tuple[str, ...] | str,
                missing: str = "drop") -> LogSources:
    """Sort given paths into directories and explicit files.
    ``missing='drop'`` skips absent paths (CLI), ``'raise'`` raises
    ``FileNotFoundError`` (library ingest)."""
    if isinstance(paths, str):
        paths = [paths]
    paths = list(dict.fromkeys(map(str, paths)))
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda p: _look_up(spark, p), paths))
    for p, (kind, _) in zip(paths, found):
        if kind is None and missing == "raise":
            raise FileNotFoundError(p)
    dirs = sorted({full for kind, full in found if kind == "dir"})
    above = lambda path: any(path != d and path.startswith(d.rstrip("/") + "/") for d in dirs)
    # What a folder's listing brings along is not taken a second time.
    files = {full for kind, full in found if kind == "file"}
    files = sorted(f for f in files if not (f.endswith(LOG_SUFFIXES) and above(f)))
    return LogSources(tuple(d for d in dirs if not above(d)), tuple(files))


def list_files(spark: SparkSession, src: LogSources) -> DataFrame:
    """(path, bytes, modified) of every file to ingest; file contents are not
    read (the binaryFile source prunes the unused content column)."""
    parts = []
    if src.dirs:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                     .option("pathGlobFilter", LOG_GLOB).load([as_literal(d) for d in src.dirs]))
    if src.files:
        parts.append(spark.read.format("binaryFile").load([as_literal(f) for f in src.files]))
    if not parts:
        return spark.createDataFrame([], "path string, bytes bigint, modified timestamp")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sized = out.select(normalise_path(F.col("path")).alias("path"), F.col("length").alias("bytes"),
                       F.col("modificationTime").alias("modified"))
    # The scan skips zero-length files; the file index still lists them.
    indexed = sorted({f for p in parts for f in p.inputFiles()})
    names = spark.createDataFrame([(f,) for f in indexed], "path string") \
        .select(normalise_path(F.col("path"), encoded=True).alias("path"))
    empty = names.join(sized.select("path"), "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"))
    return sized.unionByName(empty)


def normalise_path(uri, encoded: bool = False):
    """``file:/a/b`` -> ``/a/b``; other schemes are kept as URIs. ``encoded``: the value is percent-encoded, as
    ``_metadata.file_path`` and ``inputFiles`` are (the binaryFile source's ``path`` is not)."""
    plain = F.regexp_replace(uri, r"^file:(//)?", "")
    # url_decode reads '+' as a blank, which is for forms, not for paths
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))) if encoded else plain

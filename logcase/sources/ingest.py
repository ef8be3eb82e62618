"""Ingest: files -> normalised, redacted events (+ manifest). S1-S10.

    discover -> split stats (one scan, tiny output, checkpointed)
             -> per-file mode: lines | document candidate
             -> candidates: unwrap documents item by item
             -> numbered lines of all other files (second scan, joined to the split table)
             -> parse + redact (``parse_lines``)

Only a file whose first non-blank line may open a JSON value that is not
complete on that line, and whose last one ends with the matching bracket, is
decoded as a document, item by item; a file of complete JSON lines with two or more non-blank lines
cannot be one document. Raw lines are never shuffled: the split table alone
says which of them count. Caps are optional: a distributed ingest needs no row limit;
where given they fall at a file, in path order, before lines are parsed.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.functions.redact import SECRET_PATTERNS, SecretPattern
from logcase.operators.parse import DETECTORS, Detector, parse_lines
from logcase.plans.sizing import materialize
from logcase.session import configure, ensure_checkpoint_dir
from logcase.sources.caps import IngestCapExceeded, check_cap, rows_per_file
from logcase.sources.digest import content_digests
from logcase.sources.discover import as_literal, list_files, normalise_path, split_paths
from logcase.sources.documents import read_documents
from logcase.sources.lines import NONBLANK, number_lines, pin_split_layout, raw_scan, split_stats

#: Bytes of the split table that are broadcast at most (a row is some 100 bytes and the file's name: tables of five
#: million splits, or 600 TB in splits of 128 MB, stay below); a larger table is joined by shuffling.
SPLIT_BROADCAST_BYTES = 1 << 30

__all__ = ["IngestCapExceeded", "file_modes", "ingest", "manifest", "read_event_lines", "require_rows"]


def file_modes(stats: DataFrame) -> DataFrame:
    """Per split row, the file-level mode: 'lines', or 'doc' when the file may
    be one JSON document (its first non-blank line may open a list or object,
    its last one closes the same, and the first either is the only non-blank
    line or is not complete JSON by itself)."""
    first_split = F.when(F.col("nb") > 0, F.col("bs"))
    per_file = stats.groupBy("src", "file").agg(
        F.sum("nb").alias("file_nb"),
        F.min_by("first_open", first_split).alias("file_open"),
        F.min_by("first_complete", first_split).alias("file_complete"),
        F.max_by("last_close", first_split).alias("file_close"))
    mode = F.when((F.col("file_open") > 0) & (F.col("file_open") == F.col("file_close")) & ((F.col("file_nb") == 1) | (F.col("file_complete") == 0)), "doc") \
        .otherwise("lines")
    return stats.join(per_file.select("src", "file", mode.alias("mode")), ["src", "file"])


def _broadcast_splits(stats: DataFrame) -> DataFrame:
    """``stats`` (written already) marked for broadcast if its rows are surely few enough."""
    size = stats.agg(F.sum(F.octet_length("file") + 100)).first()[0] or 0
    return F.broadcast(stats) if size <= SPLIT_BROADCAST_BYTES else stats


def read_event_lines(spark: SparkSession, paths, missing: str = "raise", max_bytes: int | None = None,
                     max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered, non-blank event texts ``(file, line, value)`` of all files,
    documents unwrapped; and the file listing ``(path, bytes, modified)``.

    ``max_bytes`` is held against the listing before any file is read,
    ``max_rows`` against the split table before lines are scanned again.

    Raw lines are scanned twice in total (split statistics, then the numbered
    lines); document candidates are read once more."""
    configure(spark)
    ensure_checkpoint_dir(spark)
    pin_split_layout(spark)
    src = split_paths(spark, paths, missing=missing)
    listing = list_files(spark, src)
    if max_bytes is not None:
        check_cap("byte", listing, "bytes", max_bytes)
    raw = raw_scan(spark, src)
    stats = materialize(file_modes(split_stats(raw)), "splits")
    # names of candidate files: the driver's file index holds the names of all files anyway
    candidates = [r["file"] for r in stats.where(F.col("mode") == "doc").select("file").distinct().collect()]
    items = None
    if candidates:
        unwrapped = read_documents(spark, candidates)
        whole = unwrapped.where("line = 0").select("file", F.lit(True).alias("unwrapped"))
        stats = stats.join(whole, "file", "left").withColumn("mode", F.when(F.col("unwrapped"), "unwrapped").otherwise(F.col("mode")))
        stats = materialize(stats.drop("unwrapped"), "splits")
        items = unwrapped.where("line > 0")
    if max_rows is not None:
        check_cap("row", rows_per_file(stats, items, NONBLANK), "rows", max_rows)
    numbered = number_lines(raw, _broadcast_splits(stats), extra=("mode",))
    # an unknown split has no mode: its rows must stay, so that their line number fails loudly
    numbered = numbered.where(F.coalesce("mode", F.lit("lines")) != "unwrapped")
    lines = numbered.select("file", "line", "value")
    lines = lines if items is None else lines.unionByName(items)
    return lines.where(F.col("value").rlike(NONBLANK)), listing


def ingest(spark: SparkSession, paths, fallback_ts: dt.datetime | str | Column | None = None,
           patterns: tuple[SecretPattern, ...] = SECRET_PATTERNS, max_bytes: int | None = None,
           max_rows: int | None = None, rebalance: bool = False,
           detectors: tuple[str | Detector, ...] = DETECTORS) -> tuple[DataFrame, DataFrame]:
    """Events DataFrame (store schema + trace_id, request_id, format,
    ts_source) and the file listing. ``max_bytes``/``max_rows`` are optional
    caps (strictly greater raises ``IngestCapExceeded``, which names the file
    where the cap falls). ``detectors``: see ``parse_lines``.

    ``rebalance=True`` redistributes the numbered lines before parsing (an
    AQE rebalance, which also splits skewed partitions): worth a shuffle when
    a few large gzip files -- one task each -- hold much of the input."""
    lines, listing = read_event_lines(spark, paths, max_bytes=max_bytes, max_rows=max_rows)
    if rebalance:
        lines = lines.hint("rebalance")
    events = parse_lines(lines, fallback_ts=fallback_ts, patterns=patterns, detectors=detectors).select(
        "ts", "service", "level", "msg", "raw", "file", "line", "trace_id", "request_id", "format", "ts_source")
    return events, listing


def manifest(events: DataFrame, listing: DataFrame, with_sha256: bool = False,
             spark: SparkSession | None = None, with_digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-file rows, time range (files with 0 rows stay), optional
    sha256 of the file bytes (files up to 2 GiB) or ``content_digest`` of the
    lines (any size, see ``sources.digest``); and a one-row total
    (``require_rows`` raises ``ValueError`` when no rows were ingested at all).

    Pass the written store (``read_events``) rather than the lazy ``ingest``
    result when both are needed: on the lazy result the aggregation would run
    the whole parse a second time."""
    per = events.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("ts_min"),
                                     F.max("ts").alias("ts_max"))
    files = listing.join(per.withColumnRenamed("file", "path"), "path", "left").select(
        "path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), "ts_min", "ts_max")
    if with_sha256:
        if spark is None:
            raise ValueError("spark is required for sha256")
        paths = [as_literal(r["path"]) for r in listing.select("path").collect()]
        sha = spark.read.format("binaryFile").load(paths).select(
            normalise_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))
        files = files.join(sha, "path", "left")
    if with_digest:
        named = [r["path"] for r in listing.select("path").collect()]
        files = files.join(content_digests(listing.sparkSession, named), "path", "left")
    totals = files.agg(F.sum("rows").alias("total_rows"), F.min("ts_min").alias("start"),
                       F.max("ts_max").alias("end"), F.count(F.lit(1)).alias("n_files"),
                       F.sum("bytes").alias("total_bytes"))
    return files, totals


def require_rows(totals: DataFrame) -> None:
    row = totals.first()
    if row is None or not row["total_rows"]:
        raise ValueError("no rows ingested")

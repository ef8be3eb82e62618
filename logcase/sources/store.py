"""The events store on Parquet.

Layout: partitioned by ``event_date`` (UTC day of ``ts``), rows ordered by
(service, ts) inside each file, so time-window queries prune partitions and
Parquet min/max statistics skip row groups for service and time predicates.
``trace_id``/``request_id`` are plain columns: equality on them pushes down.

``layout="local"`` (default) writes without a shuffle: each task sorts its own
rows and writes one file per day it holds -- log files are mostly time-ordered,
so a task holds one or two days, and a day that holds a third of all rows is
written by all the tasks that read it. ``layout="range"`` range-partitions on
(event_date, service, ts) first (fewer, fully sorted files; it costs a sampling
pass over the input and a shuffle). ``compaction.compact`` packs small files of
a written store.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.sources.compaction import read_store

SORT_KEYS = ("event_date", "service", "ts")


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("ts"))


def write_events(events: DataFrame, path: str, mode: str = "append", layout: str = "local",
                 partitions: int | None = None, max_records_per_file: int | None = None) -> None:
    """Append (default) or overwrite the store; no upsert, no dedup."""
    df = with_event_date(events)
    if layout == "range":
        df = df.repartitionByRange(partitions, *SORT_KEYS) if partitions else df.repartitionByRange(*SORT_KEYS)
    elif layout != "local":
        raise ValueError(f"unknown layout {layout!r}")
    w = df.sortWithinPartitions(*SORT_KEYS).write
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    (w.mode(mode).partitionBy("event_date")
       .option("parquet.bloom.filter.enabled#trace_id", "true")
       .option("parquet.bloom.filter.enabled#request_id", "true")
       .parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The store's events, by its last compaction snapshot and the files appended since."""
    return read_store(spark, path)

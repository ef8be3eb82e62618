"""ST1: continuous ingest of arriving log files; ST2: windowed error counts.

ST1 lets the file stream source track which files are new (its checkpoint is
the file log) and ingests each micro-batch's files with the batch ingest, so
line numbers, documents, redaction and the store layout are identical to the
batch path. The stream itself reads no content: the ``binaryFile`` source
prunes the content column, only paths flow. Each epoch writes its own
sub-folder of the query's folder in overwrite mode, so a retried epoch
replaces its output (exactly-once at the sink), and a query with a new
checkpoint, whose epochs count from 0 again, leaves older queries' data alone.
"""
from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logcase.schema import EVENTS_SCHEMA
from logcase.session import configure, scratch_scope
from logcase.sources.discover import LOG_GLOB
from logcase.sources.ingest import ingest
from logcase.sources.store import with_event_date, write_events

#: Files of one micro-batch at most, so that a first batch over a full folder stays of bounded size.
FILES_PER_TRIGGER = 1000


def ingest_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  fallback_ts: dt.datetime | str | Column | None = None, available_now: bool = True,
                  max_files_per_trigger: int = FILES_PER_TRIGGER, processing_time: str | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    configure(spark)
    reader = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length bigint, content binary")
              .option("recursiveFileLookup", "true")
              .option("pathGlobFilter", LOG_GLOB).option("maxFilesPerTrigger", max_files_per_trigger))
    files = reader.load(source_dir).select(F.col("path"))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # FILES_PER_TRIGGER at most
        if not paths:
            return
        here = batch.sparkSession
        with scratch_scope(here):
            events, _ = ingest(here, paths, fallback_ts=fallback_ts)
            write_events(events, f"{sink_dir.rstrip('/')}/query={_query_id(here, checkpoint_dir)}/epoch={epoch}", mode="overwrite")

    w = files.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _query_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that Spark keeps in a checkpoint from before its first batch."""
    text = spark.read.text(f"{checkpoint_dir.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def read_events_stream(spark: SparkSession, store_dir: str) -> DataFrame:
    """The store as a stream of newly written Parquet files. ``event_date`` is taken from ``ts``, as when it was written."""
    schema = StructType(list(EVENTS_SCHEMA.fields))
    return with_event_date(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(store_dir))


def error_counts_stream(events: DataFrame, window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """ST2: error/warn counts per (window, service, level, msg). Rows later
    than the watermark are dropped; in append mode a window is emitted once
    the watermark passes its end, and its state is then freed."""
    return (events.where(F.col("level").isin("error", "warn"))
            .withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("window"), "service", "level", "msg")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "service", "level", "msg", "n"))

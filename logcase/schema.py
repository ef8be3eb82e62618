"""The fixed ``events`` table and the names shared by all modules."""
from __future__ import annotations

from pyspark.sql import types as T

# Core columns of the store, in order (ts is UTC wall-clock time).
EVENT_COLUMNS = ("ts", "service", "level", "msg", "raw", "file", "line")
# Columns the queries return for event rows (the reference's display columns).
ROW_COLUMNS = ("ts", "service", "level", "msg", "file", "line")

EVENTS_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("msg", T.StringType(), False),
    T.StructField("raw", T.StringType(), True),
    T.StructField("file", T.StringType(), False),
    T.StructField("line", T.LongType(), False),
    # Spark-side additions: correlation ids taken out of raw at ingest so that
    # trace lookups prune on Parquet statistics, the detected shape, and
    # whether ts came from the event or from the fallback.
    T.StructField("trace_id", T.StringType(), True),
    T.StructField("request_id", T.StringType(), True),
    T.StructField("format", T.StringType(), False),
    T.StructField("ts_source", T.StringType(), False),
])

# Detected line shapes, in detection order.
FORMATS = ("splunk", "datadog", "newrelic", "honeycomb", "generic", "text")

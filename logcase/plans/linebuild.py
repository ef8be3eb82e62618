"""Log lines in each export shape, built from log-view rows.

Used to check the parser end to end: a line is written in one shape from the
columns of the log view and must parse back to the same columns. Levels are
written in upper case (the parser lower-cases them) and timestamps as ISO
text with microseconds and ``Z``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = ("splunk_wrapped", "splunk_flat", "datadog", "datadog_legacy", "newrelic", "honeycomb",
          "generic", "plaintext")
# Shape written for each event type in the mixed file.
MIXED_SHAPE_BY_TYPE = {"error": "splunk_wrapped", "purchase": "datadog", "view": "newrelic",
                       "click": "honeycomb", "signup": "generic"}


def iso_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def shape_line(shape: str, msg: Column | None = None) -> Column:
    """The log line of one log-view row in ``shape`` (as a JSON or text column)."""
    ts, svc, lvl = iso_text(F.col("ts")), F.col("service"), F.upper(F.col("level"))
    msg = F.col("msg") if msg is None else msg
    trace_id = F.get_json_object("raw", "$.trace_id")
    if shape == "splunk_wrapped":
        obj = F.struct(F.lit(False).alias("preview"), F.col("event_id").alias("offset"),
                       F.struct(ts.alias("_time"), msg.alias("_raw"), F.lit("prod-host-1").alias("host"),
                                F.col("file").alias("source"), svc.alias("sourcetype"), lvl.alias("level"),
                                trace_id.alias("trace_id")).alias("result"))
    elif shape == "splunk_flat":
        obj = F.struct(ts.alias("_time"), msg.alias("_raw"), svc.alias("sourcetype"), lvl.alias("severity"))
    elif shape == "datadog":
        obj = F.struct(F.concat(F.lit("AQ"), F.col("event_id").cast("string")).alias("id"),
                       F.lit("log").alias("type"),
                       F.struct(ts.alias("timestamp"), F.lit("prod-host-1").alias("host"), svc.alias("service"),
                                lvl.alias("status"), msg.alias("message"),
                                F.array(F.lit("env:prod")).alias("tags"),
                                F.struct(trace_id.alias("trace_id")).alias("attributes")).alias("attributes"))
    elif shape == "datadog_legacy":
        obj = F.struct(F.col("event_id").cast("string").alias("id"),
                       F.struct(ts.alias("timestamp"), svc.alias("service"), lvl.alias("status"),
                                msg.alias("message")).alias("content"))
    elif shape == "newrelic":
        obj = F.struct(F.unix_millis(F.col("ts")).alias("timestamp"), svc.alias("service.name"),
                       lvl.alias("log.level"), msg.alias("message"), trace_id.alias("trace.id"))
    elif shape == "honeycomb":
        obj = F.struct(ts.alias("time"), F.lit(1).alias("samplerate"),
                       F.struct(svc.alias("service.name"), lvl.alias("level"), msg.alias("error.message"),
                                trace_id.alias("trace.trace_id")).alias("data"))
    elif shape == "generic":
        obj = F.struct(ts.alias("ts"), svc.alias("service"), lvl.alias("level"), msg.alias("msg"),
                       trace_id.alias("trace_id"))
    elif shape == "plaintext":
        return F.concat_ws(" ", ts, lvl, svc, msg)
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return F.to_json(obj)


def mixed_line(msg: Column | None = None) -> Column:
    """One file holding all shapes: the shape is chosen by the event type."""
    out = None
    for etype, shape in MIXED_SHAPE_BY_TYPE.items():
        cond = F.col("msg").startswith(etype + " ")
        out = F.when(cond, shape_line(shape, msg)) if out is None else out.when(cond, shape_line(shape, msg))
    return out.otherwise(shape_line("plaintext", msg))


def shape_lines(view: DataFrame, shape: str) -> DataFrame:
    """(event_id, value) lines of the log view in one shape."""
    return view.select("event_id", shape_line(shape).alias("value"))

"""Per-line shape detection and normalisation.

``parse_lines`` turns a column of raw log lines into the ``events`` columns.
Each line is parsed once into a VARIANT map; the detectors then test keys and
value types on that map in a fixed order (first hit wins):

    Splunk -> Datadog -> New Relic -> Honeycomb -> generic JSON -> plain text

The work is staged as consecutive projections (parse, detect, extract,
redact, assemble) so that Catalyst keeps one JSON parse and one redaction per
value instead of inlining them into every consumer.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.functions.jsonvals import MOST_JSON_BYTES, as_object, too_large, truthy, truthy_text, truthy_texts, value_of_wrapped, vtype, wrapped_map
from logcase.functions.redact import SECRET_PATTERNS, SecretPattern, redact
from logcase.functions.timestamps import epoch_ms_to_ts, parse_iso_ts, to_utc_timestamp_literal

# Which keys each shape reads, in priority order, and the
# default when none is truthy. They must equal the reference's adapters.
SERVICE_KEYS = {
    "splunk": (("sourcetype", "source", "host"), "splunk"),
    "datadog": (("service",), "datadog"),
    "newrelic": (("service.name", "entity.name"), "newrelic"),
    "honeycomb": (("service.name", "service"), "honeycomb"),
    "generic": (("service", "svc"), "unknown"),
}
LEVEL_KEYS = {
    "splunk": (("level", "severity", "log_level"), "info"),
    "datadog": (("status", "level"), "info"),
    "newrelic": (("log.level", "level"), "info"),
    "honeycomb": (("level", "log.level"), "info"),
    "generic": (("level", "severity"), "info"),
}
MSG_KEYS = {
    "splunk": (("_raw", "message"), ""),
    "newrelic": (("message",), ""),
    "honeycomb": (("message", "error.message", "name"), ""),
    "generic": (("msg", "message"), ""),
}
GENERIC_TS_KEYS = ("ts", "timestamp", "time")
# Key prefixes (text before the first dot) that mark New Relic and Honeycomb.
NEWRELIC_KEY_RE = r"^(service|log|trace|entity|host)\."
HONEYCOMB_KEY_RE = r"^(service|trace|app|request|error)(\.|$)"
MSG_MAX_CHARS = 500          # msg is cut after redaction (generic JSON is not cut)
PLAIN_SERVICE, PLAIN_LEVEL = "unknown", "info"

_TEXT_KEYS = tuple(sorted({k for table in (SERVICE_KEYS, LEVEL_KEYS, MSG_KEYS) for keys, _ in table.values()
                           for k in keys} | set(GENERIC_TS_KEYS) | {"_time", "timestamp"}))

#: Shapes that are looked for, in this order; what none of them claims is generic JSON or text.
DETECTORS = ("splunk", "datadog", "newrelic", "honeycomb")


@dataclass(frozen=True)
class Detector:
    """A shape of one's own, looked for beside the built-in ones.

    ``fits`` and ``event`` get the line's object as a ``map<string, variant>``
    column (``functions.jsonvals`` has what reads it: ``as_object``, ``truthy``,
    ``truthy_text``, ``vtype``). ``fits`` gives a boolean column (null counts as
    false), ``event`` columns for any of ``ts`` (timestamp), ``service``,
    ``level``, ``msg``, ``raw``, ``trace_id``, ``request_id`` (strings); what is
    left out or null gets the fallback time, ``unknown``, ``info``, an empty
    message, the line, and null ids. ``msg`` is redacted, then cut; ``level`` is
    lower-cased. The line is parsed once, however many shapes there are."""
    name: str
    fits: Callable[[Column], Column]
    event: Callable[[Column], dict[str, Column]]


#: What the event of a detector may give, with its type.
EVENT_FIELDS = {"ts": "timestamp", "service": "string", "level": "string", "msg": "string", "raw": "string",
                "trace_id": "string", "request_id": "string"}

_NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN")


def fallback_column(fallback_ts: dt.datetime | str | Column | None) -> Column:
    """The timestamp used when a line has none (default: now)."""
    if fallback_ts is None:
        return F.current_timestamp()
    if isinstance(fallback_ts, Column):
        return fallback_ts
    return to_utc_timestamp_literal(fallback_ts)


def _by_format(fmt: Column, branches: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = None
    for name, expr in branches.items():
        out = F.when(fmt == name, expr) if out is None else out.when(fmt == name, expr)
    return out.otherwise(otherwise) if otherwise is not None else out


def _own_detectors(detectors: tuple[str | Detector, ...]) -> list[Detector]:
    own = [d for d in detectors if not isinstance(d, str)]
    if unknown := {d for d in detectors if isinstance(d, str)} - set(DETECTORS):
        raise ValueError(f"unknown detectors {sorted(unknown)}")
    taken = [*DETECTORS, "generic", "text", *(d.name for d in own)]
    if twice := {n for n in taken if taken.count(n) > 1}:
        raise ValueError(f"detector names used twice: {sorted(twice)}")
    return own


def _own_events(own: list[Detector], fmt: Column, o: Column) -> list[Column]:
    """One struct of ``EVENT_FIELDS``, filled by the detector that fitted; nothing without such detectors."""
    if not own:
        return []
    filled = {}
    for d in own:
        given = d.event(o)
        if unknown := set(given) - set(EVENT_FIELDS):
            raise ValueError(f"detector {d.name}: unknown fields {sorted(unknown)}")
        filled[d.name] = F.struct(*[given.get(f, F.lit(None)).cast(t).alias(f) for f, t in EVENT_FIELDS.items()])
    return [_by_format(fmt, filled).alias("_own")]


def parse_lines(df: DataFrame, value_col: str = "value",
                fallback_ts: dt.datetime | str | Column | None = None,
                patterns: tuple[SecretPattern, ...] = SECRET_PATTERNS,
                detectors: tuple[str | Detector, ...] = DETECTORS) -> DataFrame:
    """Parse ``value_col`` into ts, service, level, msg, raw, trace_id,
    request_id, format, ts_source. Other columns pass through unchanged; the
    value column is dropped. ``detectors``: the shapes to look for, in order,
    built-in ones by name and others as a ``Detector``; the first that fits wins."""
    own = _own_detectors(detectors)
    keep = [F.col(c) for c in df.columns if c != value_col]
    names = [c for c in df.columns if c != value_col]
    v = F.col("_v")

    # 1. parse once (the wrapped map is read three times by the strict test)
    s0 = df.select(*keep, F.col(value_col).alias("_v"), wrapped_map(F.col(value_col)).alias("_w"))
    place = F.concat_ws(" line ", *[F.col(c).cast("string") for c in ("file", "line") if c in names]) if "file" in names else F.lit("a line")
    s1 = s0.select(*names, "_v", F.when(too_large(F.col("_v"), F.col("_w")), F.raise_error(F.concat(
        place, F.lit(f": JSON of more than {MOST_JSON_BYTES} bytes cannot be parsed"))))
        .otherwise(as_object(value_of_wrapped(F.col("_w")))).alias("_o"))

    # 2. detect
    o = F.col("_o")
    res = as_object(o.getItem("result"))
    splunk_src = F.coalesce(res, o)
    is_splunk = F.map_contains_key(splunk_src, "_time") | F.map_contains_key(splunk_src, "_raw")
    attrs_truthy = truthy(o.getItem("attributes"))
    dd_src = as_object(F.when(attrs_truthy, o.getItem("attributes")).otherwise(o.getItem("content")))
    is_datadog = F.coalesce(F.map_contains_key(dd_src, "timestamp"), F.lit(False))
    nr_type = vtype(o.getItem("timestamp"))
    is_newrelic = ((nr_type.isin(*_NUMERIC_TYPES) | nr_type.startswith("DECIMAL"))
                   & F.exists(F.map_keys(o), lambda k: k.rlike(NEWRELIC_KEY_RE)))
    hc_src = as_object(o.getItem("data"))
    is_honeycomb = (F.map_contains_key(o, "time") & hc_src.isNotNull()
                    & (F.map_contains_key(o, "samplerate")
                       | F.exists(F.map_keys(hc_src), lambda k: k.rlike(HONEYCOMB_KEY_RE))))
    fits = {"splunk": is_splunk, "datadog": is_datadog, "newrelic": is_newrelic, "honeycomb": is_honeycomb}
    fmt = F.when(o.isNull(), "text")
    fits |= {d.name: d.fits(o) for d in own}
    for name in (d if isinstance(d, str) else d.name for d in detectors):
        fmt = fmt.when(F.coalesce(fits[name], F.lit(False)), name)
    fmt = fmt.otherwise("generic")
    s2 = s1.select(*names, "_v", "_o", fmt.alias("_fmt"),
                   F.when(o.isNotNull(), res.isNotNull()).alias("_res_obj"),
                   attrs_truthy.alias("_dd_attrs"))

    # 3. extract (each field reads the map of its own shape)
    fmt, o = F.col("_fmt"), F.col("_o")
    src = _by_format(fmt, {
        "splunk": F.coalesce(as_object(o.getItem("result")), o),
        "datadog": as_object(F.when(F.col("_dd_attrs"), o.getItem("attributes")).otherwise(o.getItem("content"))),
        "honeycomb": as_object(o.getItem("data")),
    }, otherwise=o)
    s3a = s2.select(*names, "_v", "_o", "_fmt", "_res_obj", "_dd_attrs", src.alias("_src"))

    fmt, o, src = F.col("_fmt"), F.col("_o"), F.col("_src")
    # str(value) of every truthy value the adapters may read, once per row
    s3b = s3a.select(*names, "_v", "_o", "_fmt", "_res_obj", "_dd_attrs", "_src",
                     truthy_texts(src, _TEXT_KEYS).alias("_t"), *_own_events(own, fmt, o))
    t = F.col("_t")
    mine = {name: {d.name: F.coalesce(F.col(f"_own.{name}"), F.lit(default)) if default is not None else F.col(f"_own.{name}") for d in own}
            for name, default in (("ts", None), ("service", PLAIN_SERVICE), ("level", PLAIN_LEVEL), ("msg", ""), ("raw", None))}

    def first_of(table: dict, name: str) -> Column:
        keys, default = table[name]
        return F.coalesce(*[t.getItem(k) for k in keys], *([F.lit(default)] if default is not None else []))

    service = _by_format(fmt, {k: first_of(SERVICE_KEYS, k) for k in SERVICE_KEYS} | mine["service"], F.lit(PLAIN_SERVICE))
    level = F.lower(_by_format(fmt, {k: first_of(LEVEL_KEYS, k) for k in LEVEL_KEYS} | mine["level"], F.lit(PLAIN_LEVEL)))
    dd_nested = as_object(src.getItem("attributes"))
    msg_src = _by_format(fmt, {
        **{k: first_of(MSG_KEYS, k) for k in ("splunk", "newrelic", "honeycomb", "generic")},
        "datadog": F.coalesce(t.getItem("message"), truthy_text(dd_nested.getItem("message")), F.lit("")),
        **mine["msg"],
    }, otherwise=v)

    nr_raw = o.getItem("timestamp")
    nr_ms = F.when(vtype(nr_raw) == "BOOLEAN",
                   F.when(F.try_variant_get(nr_raw, "$", "boolean"), 1.0).otherwise(0.0)) \
        .otherwise(F.try_variant_get(nr_raw, "$", "double"))
    ts_text = _by_format(fmt, {
        "splunk": t.getItem("_time"),
        "datadog": t.getItem("timestamp"),
        "honeycomb": truthy_text(o.getItem("time")),
        "generic": F.coalesce(*[t.getItem(k) for k in GENERIC_TS_KEYS]),
    }, otherwise=v)
    parsed_ts = _by_format(fmt, {"newrelic": epoch_ms_to_ts(nr_ms)} | mine["ts"], otherwise=parse_iso_ts(ts_text))
    raw_src = _by_format(fmt, {
        "splunk": F.when(F.col("_res_obj"), F.get_json_object(v, "$.result")).otherwise(v),
        "datadog": F.when(F.col("_dd_attrs"), F.get_json_object(v, "$.attributes"))
                    .otherwise(F.get_json_object(v, "$.content")),
        "honeycomb": F.get_json_object(v, "$.data"),
        "newrelic": v, "generic": v,
        **{name: F.coalesce(raw, v) for name, raw in mine["raw"].items()},
    })
    ids = [_by_format(fmt, {"text": F.lit(None).cast("string")} | {d.name: F.col(f"_own.{k}") for d in own},
                      otherwise=F.try_variant_get(src.getItem(k), "$", "string")).alias(f"_{k}")
           for k in ("trace_id", "request_id")]
    s3 = s3b.select(*names, "_fmt", parsed_ts.alias("_ts"), service.alias("service"), level.alias("level"),
                    msg_src.alias("_msg_src"), raw_src.alias("_raw_src"), *ids)

    # 4. redact (msg before the cut; raw whole)
    s4 = s3.select(*names, "_fmt", "_ts", "service", "level",
                   redact(F.col("_msg_src"), patterns).alias("_msg_red"),
                   redact(F.col("_raw_src"), patterns).alias("_raw_red"),
                   redact(F.col("_trace_id"), patterns).alias("trace_id"),
                   redact(F.col("_request_id"), patterns).alias("request_id"))

    # 5. assemble. The result leaves through a one-row generator: a filter on
    # a parsed column stops there instead of being pushed down through the
    # stages above (which would inline every stage into the predicate, and
    # each stage reads the one before it several times).
    fmt, red = F.col("_fmt"), F.col("_msg_red")
    fb = fallback_column(fallback_ts)
    out = F.struct(
        *[F.col(n) for n in names],
        F.coalesce(F.col("_ts"), fb).alias("ts"),
        F.col("service"), F.col("level"),
        F.when(fmt == "generic", red).otherwise(F.substring(red, 1, MSG_MAX_CHARS)).alias("msg"),
        F.when(fmt == "text", F.to_json(F.struct(red.alias("text")))).otherwise(F.col("_raw_red")).alias("raw"),
        F.col("trace_id"), F.col("request_id"),
        fmt.alias("format"),
        F.when(F.col("_ts").isNull(), "fallback").otherwise("parsed").alias("ts_source"),
    )
    return s4.select(F.inline(F.array(out)))

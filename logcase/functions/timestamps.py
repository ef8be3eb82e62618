"""Timestamp parsing (P3, P6, F6). All results are UTC ``timestamp`` values."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ISO-8601 timestamp the parser looks for, anywhere in a text.
# Only the first match is tried; it must equal the reference's pattern.
ISO_TS = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"

# Python datetimes live in years 1..9999; out-of-range epochs fall back.
_MIN_MICROS = -62135596800 * 1_000_000
_MAX_MICROS = 253402300800 * 1_000_000


def parse_iso_ts(text: Column) -> Column:
    """First ISO timestamp found in ``text``; null when there is none or it is
    not a valid date. A timestamp without zone is UTC (session zone)."""
    m = F.regexp_extract(text, ISO_TS, 1)
    ts = m.try_cast("timestamp")
    # Spark accepts year 0000, Python does not.
    return F.when((m != "") & (F.year(ts) >= 1), ts)


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds (double) to a timestamp kept to microseconds; null
    outside Python's datetime range."""
    micros = F.round(ms * F.lit(1000.0))
    return F.when(micros.between(_MIN_MICROS, _MAX_MICROS - 1),
                  F.timestamp_micros(micros.cast("bigint")))


def to_utc_datetime(ts: dt.datetime | str) -> dt.datetime:
    """an ISO string (``Z`` allowed) or a datetime; naive means UTC.
    Returns the naive UTC wall-clock time."""
    if isinstance(ts, str):
        try:
            ts = dt.datetime.fromisoformat(ts.replace("Z", "+00:00"))
        except ValueError as e:
            raise ValueError(f"not an ISO timestamp: {ts!r}") from e
    if ts.tzinfo is not None:
        ts = ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return ts


def to_utc_timestamp_literal(ts: dt.datetime | str) -> Column:
    """A timestamp literal for the instant ``ts`` (see ``to_utc_datetime``).

    Built from text and cast in the session zone (UTC), so the result does not
    depend on the time zone of the Python driver process."""
    u = to_utc_datetime(ts)
    return F.lit(u.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

"""The five incident queries (Q1-Q6) and their set forms (Q7, Q8).

Each takes an ``events`` DataFrame (columns of ``logcase.schema.EVENTS_SCHEMA``;
only ts, service, level, msg, raw, file, line are required) and returns a
DataFrame. Orderings are total -- ties are broken by (file, line) -- so that a
limit returns the same rows on every run.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcase.functions.display import MSG_SHORT, msg_short
from logcase.functions.timestamps import to_utc_timestamp_literal
from logcase.plans.sizing import broadcast_if_small
from logcase.schema import ROW_COLUMNS

ROW_ORDER = ("ts", "file", "line")
ERROR_LEVELS = ("error", "warn")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*ROW_COLUMNS)


def describe(events: DataFrame) -> DataFrame:
    """Q1 schema(): distinct services and levels (sorted), first and last
    timestamp and row count, in one aggregation pass. An empty table gives
    empty arrays, null times and 0."""
    return events.agg(
        F.sort_array(F.collect_set("service")).alias("services"),
        F.sort_array(F.collect_set("level")).alias("levels"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def describe_services(events: DataFrame) -> DataFrame:
    """Q1 in long form for stores with very many services: one row per
    (service, level) with its count and time range."""
    return events.groupBy("service", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def top_errors(events: DataFrame, limit: int = 20) -> DataFrame:
    """Q2: most frequent (service, level, msg) among error/warn rows.
    Partial aggregation runs before the shuffle, so a hot message costs one
    row per task; the top-k is a single TakeOrderedAndProject."""
    return (events.where(F.col("level").isin(*ERROR_LEVELS))
            .groupBy("service", "level", "msg")
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "service", "level", "msg")
            .limit(limit))


def _like_escape(pattern: str) -> str:
    for c in "!#^~|@&;":
        if c not in pattern:
            return c
    for code in range(0x2400, 0x2500):   # a symbol the pattern does not hold
        if chr(code) not in pattern:
            return chr(code)
    raise ValueError("no escape character available")


def search_predicate(pattern: str, mode: str = "like") -> Column:
    """case-insensitive match of ``pattern`` anywhere in msg or raw.

    ``mode='like'`` (reference): ``%`` and ``_`` in the pattern are wildcards
    and ``\\`` is an ordinary character. ``mode='literal'``: the pattern is
    matched as plain text."""
    if mode == "literal":
        needle = F.lower(F.lit(pattern))
        return (F.coalesce(F.contains(F.lower("msg"), needle), F.lit(False))
                | F.coalesce(F.contains(F.lower("raw"), needle), F.lit(False)))
    if mode != "like":
        raise ValueError(f"unknown search mode {mode!r}")
    esc = _like_escape(pattern)
    like = F.lit(f"%{pattern}%")
    return (F.coalesce(F.ilike("msg", like, F.lit(esc)), F.lit(False))
            | F.coalesce(F.ilike("raw", like, F.lit(esc)), F.lit(False)))


def search(events: DataFrame, pattern: str, limit: int = 10, mode: str = "like") -> DataFrame:
    """Q3: first ``limit`` matching rows in time order."""
    return _rows(events.where(search_predicate(pattern, mode))).orderBy(*ROW_ORDER).limit(limit)


def _date_bounds(events: DataFrame, lo: Column, hi: Column) -> Column | None:
    if "event_date" in events.columns:
        return F.col("event_date").between(F.to_date(lo), F.to_date(hi))
    return None


def around(events: DataFrame, ts: dt.datetime | str, window_s: float = 60,
           service: str | None = None) -> DataFrame:
    """Q4: rows with ``ts - window_s <= ts <= ts + window_s`` (inclusive),
    optionally of one service (an empty string means all). On a store written
    by ``write_events`` the added ``event_date`` range prunes partitions."""
    centre = to_utc_timestamp_literal(ts)
    delta = F.make_dt_interval(secs=F.lit(float(window_s)))
    lo, hi = centre - delta, centre + delta
    cond = F.col("ts").between(lo, hi)
    part = _date_bounds(events, lo, hi)
    if part is not None:
        cond = part & cond
    if service:
        cond = cond & (F.col("service") == service)
    return _rows(events.where(cond)).orderBy(*ROW_ORDER)


def trace_predicate(events: DataFrame, trace_id: str, id_paths: tuple[str, ...] = ()) -> Column:
    """top-level ``trace_id`` or ``request_id`` of raw equals the id.
    Uses the columns materialised at ingest when present. ``id_paths``: more
    places in ``raw``, as JSON paths (``$.attributes.trace_id``,
    ``$['trace.trace_id']``); they are read from every row, without pushdown."""
    if "trace_id" in events.columns and "request_id" in events.columns:
        tid, rid = F.col("trace_id"), F.col("request_id")
    else:
        tid, rid = F.get_json_object("raw", "$.trace_id"), F.get_json_object("raw", "$.request_id")
    # plain equalities (null counts as false in a filter) so that Parquet gets them
    found = (tid == trace_id) | (rid == trace_id)
    for path in id_paths:
        found = found | (F.get_json_object("raw", path) == trace_id)
    return found


def trace(events: DataFrame, trace_id: str, id_paths: tuple[str, ...] = ()) -> DataFrame:
    """Q5: all rows of one correlation id, in time order."""
    return _rows(events.where(trace_predicate(events, trace_id, id_paths))).orderBy(*ROW_ORDER)


def with_msg_short(df: DataFrame, query: str) -> DataFrame:
    """Q6: add the display cut of msg used by the given query."""
    return df.withColumn("msg_short", msg_short(F.col("msg"), MSG_SHORT[query]))


def _epoch_s(c: Column) -> Column:
    return F.unix_micros(c) / F.lit(1_000_000.0)


def around_many(events: DataFrame, anchors: DataFrame, window_s: float = 60,
                anchor_id: str = "anchor_id", anchor_ts: str = "anchor_ts", anchor_service: str | None = None,
                broadcast_max_rows: int = 2_000_000) -> DataFrame:
    """Q7 (Spark-side addition): ``around`` for many anchors at once, as one
    row per (anchor, event) pair: in a burst the pairs grow with its square,
    ``around_counts`` gives per-anchor numbers without them.
    ``anchor_service`` names a column of ``anchors`` with the service to keep
    (null or empty: all).

    Interval join as an equi-join: time is cut into buckets of ``window_s``;
    an anchor covers at most three buckets, so it is exploded to those and
    joined to events on the bucket, then filtered exactly. Anchors are
    broadcast only when their count is proven small; otherwise both sides
    shuffle on the bucket and AQE splits a bucket that holds a burst."""
    if window_s <= 0:
        raise ValueError("window_s must be positive")
    w = float(window_s)
    a = anchors.select(F.col(anchor_id).alias("anchor_id"), F.col(anchor_ts).alias("anchor_ts"),
                       (F.col(anchor_service) if anchor_service else F.lit(None).cast("string")).alias("_s"))
    a = a.withColumn("_b", F.explode(F.sequence(
        F.floor((_epoch_s(F.col("anchor_ts")) - w) / w).cast("bigint"),
        F.floor((_epoch_s(F.col("anchor_ts")) + w) / w).cast("bigint"))))
    e = events.select(*ROW_COLUMNS).withColumn("_b", F.floor(_epoch_s(F.col("ts")) / w).cast("bigint"))
    a = broadcast_if_small(a, broadcast_max_rows)
    delta = F.make_dt_interval(secs=F.lit(w))
    j = e.join(a, "_b").where(F.col("ts").between(F.col("anchor_ts") - delta, F.col("anchor_ts") + delta))
    if anchor_service:
        j = j.where((F.coalesce("_s", F.lit("")) == "") | (F.col("_s") == F.col("service")))
    return j.select("anchor_id", "anchor_ts", *ROW_COLUMNS)


def around_counts(events: DataFrame, anchors: DataFrame, window_s: int = 60,
                  anchor_id: str = "anchor_id", anchor_ts: str = "anchor_ts") -> DataFrame:
    """Per anchor, how many events lie within ``window_s`` seconds of it.

    No pairs are made: events are counted per microsecond, the counts become
    running totals, and an anchor's number is the difference of the totals at
    its two ends. Time is cut into buckets of ``window_s``: totals run inside
    a bucket, and each of an anchor's (at most three) buckets gives its part."""
    w = int(window_s * 1_000_000)
    if w <= 0:
        raise ValueError("window_s must be positive")
    a = anchors.select(F.struct(F.col(anchor_id).alias("anchor_id"), F.col(anchor_ts).alias("anchor_ts")).alias("k"),
                       F.unix_micros(anchor_ts).alias("c"))
    a = a.withColumn("b", F.explode(F.sequence(F.floor((F.col("c") - w) / w), F.floor((F.col("c") + w) / w))))
    low, high = F.greatest(F.col("c") - w, F.col("b") * w), F.least(F.col("c") + w, (F.col("b") + 1) * w - 1)
    ends = a.select("b", "k", F.explode(F.array(F.struct((low - 1).alias("t"), F.lit(-1).alias("side")),
                                               F.struct(high.alias("t"), F.lit(1).alias("side")))).alias("e")) \
        .select("b", F.col("e.t").alias("t"), F.lit(0).cast("bigint").alias("n"), F.col("e.side").alias("side"), "k")
    at = events.select(F.unix_micros("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n")).select(
        F.floor(F.col("t") / w).alias("b"), "t", "n", F.lit(0).alias("side"), F.lit(None).cast(ends.schema["k"].dataType).alias("k"))
    upto = Window.partitionBy("b").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = at.unionByName(ends).withColumn("total", F.sum("n").over(upto)).where("side <> 0")
    return total.groupBy("k").agg(F.sum(F.col("side") * F.col("total")).alias("n")).select("k.*", "n")


def trace_many(events: DataFrame, ids: DataFrame, id_col: str = "id",
               broadcast_max_rows: int = 2_000_000) -> DataFrame:
    """Q8 (Spark-side addition): ``trace`` for many ids at once.

    Each event is keyed by its distinct non-null correlation ids (trace_id,
    request_id) and equi-joined to the id list. A hot id is the skew case:
    the id list is broadcast when small, else AQE's skew-join split applies."""
    if "trace_id" in events.columns and "request_id" in events.columns:
        tid, rid = F.col("trace_id"), F.col("request_id")
    else:
        tid, rid = F.get_json_object("raw", "$.trace_id"), F.get_json_object("raw", "$.request_id")
    keyed = events.select(*ROW_COLUMNS, F.explode(F.array_distinct(
        F.filter(F.array(tid, rid), lambda x: x.isNotNull()))).alias("id"))
    want = broadcast_if_small(ids.select(F.col(id_col).alias("id")).distinct(), broadcast_max_rows)
    return keyed.join(want, "id").select("id", *ROW_COLUMNS)

"""Registered checks of whole files: caps in path order, content digests, a shape of one's own, a compacted store.

Inputs are built from the whole ``events`` table, in files whose number grows with it; the SQL is written out by itself.
"""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.functions.jsonvals import truthy_text, vtype
from logcase.operators.parse import DETECTORS, Detector, parse_lines
from logcase.plans import linebuild as LB
from logcase.plans.checks import FALLBACK_TS, ntz
from logcase.plans.logfiles import logical_name
from logcase.plans.logview import load_log_view, with_log_view
from logcase.plans.sizing import materialize
from logcase.session import scratch_dir
from logcase.sources.caps import path_order, rows_per_file, running_total
from logcase.sources.compaction import TARGET_BYTES, compact, live_files
from logcase.sources.digest import content_digests
from logcase.sources.discover import list_files, split_paths
from logcase.sources.ingest import IngestCapExceeded, file_modes, ingest
from logcase.sources.lines import NONBLANK, raw_scan, split_stats
from logcase.sources.store import read_events, write_events

#: Events of one file.
FILE_EVENTS = 1000


def _files(view: DataFrame, value: Column, name: str, **options: str) -> list[str]:
    """One file per ``FILE_EVENTS`` events, in a folder named by its number, with a line for each event in order."""
    path = scratch_dir(view.sparkSession, name)
    block = F.floor(F.col("event_id") / FILE_EVENTS)
    rows = view.select(F.lpad(block.cast("string"), 9, "0").alias("name"), "event_id", value.alias("value"))
    rows.repartition("name").sortWithinPartitions("name", "event_id").select("name", "value").write.options(**options).partitionBy("name").text(path)
    # by name: plain text files have no suffix that a folder's listing looks for
    return [unquote(f) for f in view.sparkSession.read.text(path).inputFiles()]
    return path


def q_ingest_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals of bytes and rows per file, and the files at which caps of half of each fall as ``ingest`` finds them."""
    view = load_log_view(spark, sf)
    # every seventh line is blank: it has bytes but is no row
    paths = _files(view, F.when(F.col("event_id") % 7 == 3, "  ").otherwise(F.col("msg")), "capped")
    src = split_paths(spark, paths)
    splits = file_modes(split_stats(raw_scan(spark, src)))
    rows = rows_per_file(splits, None, NONBLANK)
    both = materialize(list_files(spark, src).join(rows, "path", "left").select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows")), "caps")
    totals = both.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    fell = {}
    for what, cap in (("bytes", totals["bytes"]), ("rows", totals["rows"])):
        try:
            ingest(spark, paths, **{f"max_{what}": (cap or 0) // 2})
        except IngestCapExceeded as e:
            fell[what] = e
    here = lambda what: (F.col("path") == fell[what].path) & (F.col("total") == fell[what].total) if what in fell else F.lit(False)
    out = running_total(both, path_order(F.col("path")), "bytes", "total").withColumn("byte_cap_here", here("bytes")).withColumnRenamed("total", "total_bytes")
    out = running_total(out, path_order(F.col("path")), "rows", "total").withColumn("row_cap_here", here("rows")).withColumnRenamed("total", "total_rows")
    return out.select(logical_name(F.col("path")).alias("file"), "bytes", "total_bytes", "rows", "total_rows", "byte_cap_here", "row_cap_here")


def q_ingest_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Content digests of the same lines in plain and in packed files."""
    view = load_log_view(spark, sf)
    found = None
    for kind, options in (("plain", {}), ("gzip", {"compression": "gzip"})):
        files = content_digests(spark, _files(view, F.col("raw"), f"digest-{kind}", **options))
        rows = files.select(F.lit(kind).alias("kind"), logical_name(F.col("path")).alias("file"), "n_lines", "content_digest")
        found = rows if found is None else found.unionByName(rows)
    return found


#: A shape that no built-in adapter knows: syslog-like keys, a numeric severity, seconds since 1970.
SEVERITIES = ("emerg", "alert", "crit", "error", "warn", "notice", "info", "debug")
OWN_SHAPE = Detector(
    "sysline",
    fits=lambda o: F.map_contains_key(o, "short_message") & vtype(o.getItem("severity")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
    event=lambda o: {
        "ts": F.timestamp_micros(F.round(F.try_variant_get(o.getItem("at"), "$", "decimal(20,6)") * 1_000_000).cast("bigint")),
        "service": truthy_text(o.getItem("host")),
        "level": F.get(F.array(*map(F.lit, SEVERITIES)), F.try_variant_get(o.getItem("severity"), "$", "int")),
        "msg": F.try_variant_get(o.getItem("short_message"), "$", "string"),
        "trace_id": F.try_variant_get(o.getItem("_trace"), "$", "string")})


def q_parse_own_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the caller's own shape among generic ones, parsed by an argument alone."""
    view = load_log_view(spark, sf, even=True)
    k = F.col("event_id") % 4
    own = F.to_json(F.struct(
        F.when(k != 1, F.col("service")).alias("host"), F.format_string("@%s@", F.unix_micros("ts").cast("decimal(20,0)") / 1_000_000).alias("at"),
        F.when(F.col("level") == "error", 3).when(F.col("level") == "warn", 4).otherwise(6).alias("severity"), F.concat(
            F.col("msg"), F.lit(" Bearer "), F.md5("raw")).alias("short_message"), F.get_json_object("raw", "$.trace_id").alias("_trace")))
    own = F.regexp_replace(own, '"@([0-9.]+)@"', "$1")  # a number with all its digits
    generic = F.to_json(F.struct(LB.iso_text(F.col("ts")).alias("ts"), "service", "level", "msg", F.lit("high").alias("severity"),
                                 F.lit("also here").alias("short_message")))
    lines = view.select("event_id", F.md5("raw").alias("token"), F.when(k == 3, generic).otherwise(own).alias("value"))
    out = parse_lines(lines, fallback_ts=FALLBACK_TS, detectors=(OWN_SHAPE, *DETECTORS))
    return ntz(out.select("event_id", "ts", "ts_source", "service", "level", "msg", "format", "trace_id",
                          F.col("raw").contains(F.col("token")).alias("leaked")), "ts")


def q_store_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each day in a store written by several appends, compacted, and appended to again."""
    view, store = load_log_view(spark, sf), scratch_dir(spark, "packed-store")
    part = lambda k: write_events(view.where(F.col("event_id") % 3 == k).drop("event_id"), store)
    part(0)
    part(1)
    compact(spark, store)
    day = F.to_date(F.regexp_extract("file", "/event_date=([^/]+)/", 1)).alias("event_date")
    files = live_files(spark, store).groupBy(day).agg((F.count("*") * TARGET_BYTES <= 2 * F.sum("bytes") + 2 * TARGET_BYTES).alias("packed"))
    files = materialize(files, "packed-days")
    part(2)
    days = read_events(spark, store).groupBy("event_date").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("line").alias("line_sum"))
    return ntz(days.join(files, "event_date", "left").withColumn("packed", F.coalesce("packed", F.lit(True))), "first_ts", "last_ts")


QUERIES = {f.__name__.removeprefix("q_"): f for f in (q_ingest_caps, q_ingest_digest, q_parse_own_shape, q_store_compaction)}

_WORD_SUMS = " || ',' || ".join(
    f"CAST(CAST(sum(CAST(('0x' || substr(h, {8 * k + 1}, 8)) AS BIGINT)) AS HUGEINT) % 4294967296 AS VARCHAR)" for k in range(8))

ORACLE_SQL = {
    "ingest_caps": with_log_view(f"""
WITH lines AS (SELECT lpad(CAST(event_id // {FILE_EVENTS} AS VARCHAR), 9, '0') AS file, event_id % 7 = 3 AS blank, msg FROM log_events),
files AS (SELECT file, CAST(sum(CASE WHEN blank THEN 3 ELSE strlen(msg) + 1 END) AS BIGINT) AS bytes,
                 count(*) FILTER (NOT blank) AS rows FROM lines GROUP BY file),
upto AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY file) AS BIGINT) AS total_bytes, CAST(sum(rows) OVER (ORDER BY file) AS BIGINT) AS total_rows,
                CAST(sum(bytes) OVER () AS BIGINT) // 2 AS byte_cap, CAST(sum(rows) OVER () AS BIGINT) // 2 AS row_cap FROM files)
SELECT file, bytes, total_bytes, rows, total_rows, total_bytes > byte_cap AND total_bytes - bytes <= byte_cap AS byte_cap_here,
       total_rows > row_cap AND total_rows - rows <= row_cap AS row_cap_here FROM upto"""),
    "ingest_digest": with_log_view(f"""
WITH lines AS (SELECT lpad(CAST(event_id // {FILE_EVENTS} AS VARCHAR), 9, '0') AS file, raw,
                      row_number() OVER (PARTITION BY event_id // {FILE_EVENTS} ORDER BY event_id) AS line FROM log_events),
files AS (SELECT file, count(*) AS n_lines, {_WORD_SUMS} AS words FROM (SELECT file, sha256(line || ':' || raw) AS h FROM lines) GROUP BY file)
SELECT kind, file, n_lines, sha256(n_lines || ':' || words) AS content_digest FROM files, (VALUES ('plain'), ('gzip')) k(kind)"""),
    "store_compaction": with_log_view("""
SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(line) AS BIGINT) AS line_sum, true AS packed
FROM log_events GROUP BY 1"""),
    "parse_own_shape": with_log_view("""
SELECT event_id, ts, 'parsed' AS ts_source, CASE WHEN event_id % 4 = 1 THEN 'unknown' ELSE service END AS service, level,
  CASE WHEN event_id % 4 = 3 THEN msg ELSE msg || ' Bearer [REDACTED_BEARER]' END AS msg,
  CASE WHEN event_id % 4 = 3 THEN 'generic' ELSE 'sysline' END AS format,
  CASE WHEN event_id % 4 <> 3 THEN json_extract_string(raw, '$.trace_id') END AS trace_id, false AS leaked FROM log_events"""),
}

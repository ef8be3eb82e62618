"""Registered checks of the edges: wrapped documents, odd names, faulty case files, streams, values a parser falls back on.

Inputs are built from the whole ``events`` table; the SQL is written out by itself and shares no pattern, table or rule
with the product.
"""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.operators.casefile import attach_truth, case_summary, parse_cases, parse_ground_truth, usage_totals, validate_cases
from logcase.operators.parse import parse_lines
from logcase.plans import linebuild as LB
from logcase.plans.checks import FALLBACK_TS, case_document, ntz
from logcase.plans.logfiles import logical_name
from logcase.plans.logview import load_log_view, with_log_view
from logcase.plans.sizing import materialize
from logcase.session import configure, scratch_dir
from logcase.sources.casefiles import read_cases, write_cases
from logcase.sources.ingest import ingest, manifest
from logcase.sources.search_index import search_store, update_search_index
from logcase.sources.store import write_events
from logcase.streaming import error_counts_stream, read_events_stream

#: Events of one document at most.
DOC_EVENTS = 500
#: Searches through the sidecar: wildcards on both sides, one short run, a text that no event holds.
INDEXED_PATTERNS = {"wildcards": "VIEW K=1%", "one character": "r_or k", "short": "k=", "absent": "no such text"}


def _files(named: DataFrame, spark: SparkSession, what: str, **options: str) -> str:
    """Writes ``value`` rows (in order of ``k``) to one folder per ``name``."""
    path = scratch_dir(spark, what)
    named.repartition("name").sortWithinPartitions("name", "k").select("name", "value").write.options(**options).partitionBy("name").text(path)
    return path


def q_ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in five wrappers, and text logs whose lines begin with a bracket."""
    view = load_log_view(spark, sf)
    item = F.to_json(F.struct(LB.iso_text(F.col("ts")).alias("ts"), "service", F.upper("level").alias("level"), "msg"))
    kind = F.col("event_id") % 6
    name = F.concat_ws("-", F.lit("doc"), kind.cast("string"), F.floor(F.col("event_id") / (6 * DOC_EVENTS)).cast("string"))
    docs = view.where(kind < 5).groupBy(name.alias("name"), kind.alias("kind")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("j")))), lambda x: x["j"]), ", ").alias("j"))
    text = F.element_at(F.array(
        F.format_string("[%s]", "j"), F.format_string('{"meta": {"n": 1}, "data": [%s]}', "j"), F.format_string('{"events":[%s] }', "j"),
        F.format_string('{"results": [%s], "events": 7}', "j"), F.format_string('{"results": [{"events": [%s]}, {"events": [1]}]}', "j")),
        (F.col("kind") + 1).cast("int"))
    lines = view.where(kind == 5).select(F.lit("plain").alias("name"), F.col("event_id").alias("k"), F.format_string(
        "[%s] %s]", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("msg")).alias("value"))
    path = _files(docs.select("name", F.lit(0).cast("bigint").alias("k"), text.alias("value")).unionByName(lines), spark, "documents", compression="gzip")
    events, _ = ingest(spark, [path], fallback_ts=FALLBACK_TS)
    return ntz(events.select(logical_name(F.col("file")).alias("file"), "line", "ts", "service", "level", "msg", "format"), "ts")


def q_ingest_odd_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with blanks, brackets and plus signs; every file given twice."""
    view = load_log_view(spark, sf)
    name = F.concat(F.lit("my +app ("), (F.col("event_id") % 4).cast("string"), F.lit(") é"))
    path = _files(view.select(name.alias("name"), F.col("event_id").alias("k"), F.col("msg").alias("value")), spark, "odd names")
    paths = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    events, listing = ingest(spark, paths + paths[::-1], fallback_ts=FALLBACK_TS)
    files, _ = manifest(events, listing)
    last = events.groupBy("file").agg(F.max("line").alias("last_line"))
    out = files.join(last, files["path"] == last["file"]).select(logical_name(F.col("path")).alias("file"), "bytes", "rows", "last_line")
    return out.groupBy("file").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("bytes", "rows")], F.max("last_line").alias("last_line"))


def q_parse_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with falsy first choices, no time, long messages, blanks, numbers, and what is no object."""
    view = load_log_view(spark, sf, even=True)
    msg, svc, token = F.col("msg"), F.col("service"), F.md5("raw")
    j = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    forms = F.array(
        j(F.lit("").alias("service"), svc.alias("svc"), F.lit(0).alias("level"), F.lit("Notice").alias("severity"), msg.alias("message")),
        j(F.lit(None).cast("string").alias("service"), F.lit(True).alias("svc"), msg.alias("msg"), F.col("event_id").alias("request_id")),
        F.concat(F.lit("  "), msg, F.lit(" Bearer "), token, F.lit(" "), F.repeat(F.lit("z"), 600)),
        F.col("event_id").cast("string"), F.concat(F.lit('["'), msg, F.lit('"]')), F.concat(F.lit('{"msg":"'), msg, F.lit('"} tail')),
        F.concat(F.lit('{"msg":"first","msg":"'), msg, F.lit('","trace_id":17}')))
    kind = (F.col("event_id") % 7).cast("int")
    lines = view.select("event_id", token.alias("token"), F.element_at(forms, kind + 1).alias("value"))
    out = parse_lines(lines, fallback_ts=FALLBACK_TS)
    return ntz(out.select("event_id", "ts", "ts_source", "service", "level", "msg", "format", "trace_id", "request_id",
                          F.col("raw").contains(F.col("token")).alias("leaked")), "ts")


def q_case_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One kind of fault per case file, by event id."""
    docs = case_document(spark, sf)
    text, k = F.col("text"), F.col("case_id") % 8
    swap = lambda pattern, new: F.regexp_replace(text, pattern, new)
    faulty = F.when(k == 1, F.concat(text, F.lit(" x"))).when(k == 2, swap('"total_rows":\\d+', '"total_rows":"abc"')).when(
        k == 3, swap('"question":"[^"]*"', '"question":null')).when(k == 4, swap('"model":\\{[^}]*\\}', '"model":"gpt"')).when(
        k == 5, swap('"start":"[^"]*"', '"start":"never"')).when(k == 6, swap('"remediation":', '"remedy":')).when(
        k == 7, swap('"blast_radius":"[^"]*"', '"blast_radius":3')).otherwise(text)
    v = validate_cases(parse_cases(docs.withColumn("text", faulty)))
    return v.select("case_id", "valid", F.array_join(F.array_sort("violations"), ",").alias("violations"))


def q_case_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Valid cases written, many to a file, and read back."""
    path = scratch_dir(spark, "cases")
    write_cases(validate_cases(parse_cases(case_document(spark, sf))).where("valid"), path)
    back = case_summary(validate_cases(read_cases(spark, path, layout="lines")))
    return back.select(F.col("case_id").cast("bigint").alias("case_id"), "valid", "root_cause", F.col("n_evidence").cast("bigint").alias("n_evidence"))


def q_case_usage_and_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Usage per model, and how many of its cases have a ground truth."""
    docs = case_document(spark, sf).withColumn("text", F.concat(F.expr("left(text, length(text) - 1)"), F.lit(',"usage":{"llm_calls":'), (
        F.col("case_id") % 5).cast("string"), F.lit(',"wall_clock_s":0.5}}')))
    cases = validate_cases(parse_cases(docs)).withColumn("incident_id", F.col("case_id").cast("string"))
    truth = docs.where("case_id % 3 = 0").select(F.col("case_id").cast("string").alias("incident_id"), F.concat(
        F.lit('{"incident_id":"'), F.col("case_id").cast("string"), F.lit('","root_cause":"r","distractors":[{"event":"e1"},{"note":2}]}')).alias("text"))
    both = materialize(attach_truth(cases, parse_ground_truth(truth)).select("case", "gt", "distractor_ids"), "truths")
    with_truth = both.groupBy(F.col("case.model.name").alias("model")).agg(
        F.count("gt.root_cause").alias("n_truth"), F.sum(F.greatest(F.size("distractor_ids"), F.lit(0))).alias("n_distractors"))
    return usage_totals(both).join(with_truth, "model").select(
        "model", *[F.col(c).cast("bigint").alias(c) for c in ("n_cases", "llm_calls", "tool_calls", "n_truth", "n_distractors")], "wall_clock_s")


def _stored(view: DataFrame) -> DataFrame:
    """The log view with the columns of a store."""
    return view.select("ts", "service", "level", "msg", "raw", "file", "line", F.lit(None).cast("string").alias("trace_id"),
                       F.lit(None).cast("string").alias("request_id"), F.lit("generic").alias("format"), F.lit("parsed").alias("ts_source"))


def q_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Searches over a written store through its trigram sidecar, one pattern that stands in few files among them."""
    configure(spark)
    store = scratch_dir(spark, "indexed-store")
    write_events(_stored(load_log_view(spark, sf)), store, mode="overwrite", layout="range")
    update_search_index(spark, store)
    found = None
    for name, pattern in INDEXED_PATTERNS.items():
        rows = search_store(spark, store, pattern).select(F.lit(name).alias("pattern"), "ts", "service", "level", "msg", "file", "line")
        found = rows if found is None else found.unionByName(rows)
    return ntz(found, "ts")


def q_error_counts_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed counts as a stream over a written store, in complete mode."""
    view = load_log_view(spark, sf)
    store, out, ckpt = (scratch_dir(spark, n) for n in ("stream-store", "stream-counts", "stream-state"))
    write_events(_stored(view), store, mode="overwrite")
    counts = error_counts_stream(read_events_stream(spark, store), window="1 hour", watermark="1 hour")
    counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    return ntz(found.withColumn("n", F.col("n").cast("bigint")), "window_start", "window_end")


QUERIES = {f.__name__.removeprefix("q_"): f for f in (
    q_ingest_documents, q_ingest_odd_names, q_parse_fallbacks, q_case_violations, q_case_roundtrip, q_case_usage_and_truth, q_search_indexed, q_error_counts_streamed)}

_CASE_BASE = """SELECT l.event_id AS case_id, l.level, l.msg, l.service, e.value / 100.0 AS confidence, l.event_id % 8 AS k
FROM log_events l JOIN events e USING (event_id)"""

ORACLE_SQL = {
    "ingest_documents": with_log_view(f"""
SELECT CASE WHEN event_id % 6 = 5 THEN 'plain' ELSE concat('doc-', event_id % 6, '-', event_id // {6 * DOC_EVENTS}) END AS file,
  row_number() OVER (PARTITION BY CASE WHEN event_id % 6 = 5 THEN 'plain' ELSE concat('doc-', event_id % 6, '-', event_id // {6 * DOC_EVENTS}) END
                     ORDER BY event_id) AS line,
  CASE WHEN event_id % 6 = 5 THEN date_trunc('second', ts) ELSE ts END AS ts,
  CASE WHEN event_id % 6 = 5 THEN 'unknown' ELSE service END AS service, CASE WHEN event_id % 6 = 5 THEN 'info' ELSE level END AS level,
  CASE WHEN event_id % 6 = 5 THEN strftime(ts, '[%Y-%m-%d %H:%M:%S] ') || msg || ']' ELSE msg END AS msg,
  CASE WHEN event_id % 6 = 5 THEN 'text' ELSE 'generic' END AS format
FROM log_events"""),
    "ingest_odd_names": with_log_view("""
SELECT concat('my +app (', event_id % 4, ') é') AS file, CAST(sum(strlen(msg) + 1) AS BIGINT) AS bytes,
       CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS last_line FROM log_events GROUP BY 1"""),
    "parse_fallbacks": with_log_view("""
SELECT event_id, TIMESTAMP '1970-01-01' AS ts, 'fallback' AS ts_source,
  CASE event_id % 7 WHEN 0 THEN service WHEN 1 THEN 'True' ELSE 'unknown' END AS service,
  CASE event_id % 7 WHEN 0 THEN 'notice' ELSE 'info' END AS level,
  CASE event_id % 7 WHEN 2 THEN left('  ' || msg || ' Bearer [REDACTED_BEARER] ' || repeat('z', 600), 500)
    WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN '["' || msg || '"]' WHEN 5 THEN '{"msg":"' || msg || '"} tail' ELSE msg END AS msg,
  CASE WHEN event_id % 7 IN (0, 1, 6) THEN 'generic' ELSE 'text' END AS format,
  CASE event_id % 7 WHEN 6 THEN '17' END AS trace_id, CASE WHEN event_id % 7 = 1 AND event_id > 0 THEN CAST(event_id AS VARCHAR) END AS request_id,
  false AS leaked
FROM log_events"""),
    "case_violations": with_log_view(f"""
SELECT case_id, len(codes) = 0 AS valid, array_to_string(list_sort(codes), ',') AS violations FROM (
  SELECT case_id, CASE WHEN k = 1 THEN ['not_an_object'] ELSE list_filter([
    CASE WHEN level NOT IN ('error', 'warn') THEN 'enum:trajectory[0].tool=bogus_tool' END,
    CASE WHEN confidence > 1 THEN 'range:report.confidence' END,
    CASE k WHEN 2 THEN 'type:logs_manifest.total_rows' WHEN 3 THEN 'null:case.question' WHEN 4 THEN 'type:case.model'
      WHEN 5 THEN 'type:logs_manifest.time_window.start' WHEN 6 THEN 'missing:report.remediation' WHEN 7 THEN 'type:report.blast_radius' END,
    CASE k WHEN 6 THEN 'unknown_key:report:remedy' END], lambda x: x IS NOT NULL) END AS codes
  FROM ({_CASE_BASE}))"""),
    "case_roundtrip": with_log_view(
        f"SELECT case_id, true AS valid, msg AS root_cause, CAST(1 AS BIGINT) AS n_evidence FROM ({_CASE_BASE}) "
        "WHERE level IN ('error', 'warn') AND confidence <= 1"),
    "case_usage_and_truth": with_log_view("""
SELECT service AS model, count(*) AS n_cases, CAST(sum(event_id % 5) AS BIGINT) AS llm_calls, CAST(0 AS BIGINT) AS tool_calls,
  count(*) FILTER (event_id % 3 = 0) AS n_truth, count(*) FILTER (event_id % 3 = 0) AS n_distractors, count(*) * 0.5::DOUBLE AS wall_clock_s
FROM log_events GROUP BY service"""),
    "search_indexed": with_log_view(" UNION ALL ".join(
        f"(SELECT '{name}' AS pattern, ts, service, level, msg, file, line FROM log_events WHERE msg ILIKE '%{p}%' OR raw ILIKE '%{p}%' "
        "ORDER BY ts, file, line LIMIT 10)" for name, p in INDEXED_PATTERNS.items())),
    "error_counts_streamed": with_log_view(
        "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, "
        "service, level, msg, CAST(count(*) AS BIGINT) AS n FROM log_events WHERE level IN ('error', 'warn') GROUP BY ALL"),
}

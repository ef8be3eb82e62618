"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads whole tables (no id subsets or row caps); a limit appears
only where it is the feature (top-k, first-k search hits). Result columns are
aliased identically on both sides; timestamps are returned as
``timestamp_ntz`` (the driver's type) and counts as ``bigint``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.functions.redact import redact, redaction_audit
from logcase.operators import grading as G
from logcase.operators import queries as Q
from logcase.operators.parse import parse_lines
from logcase.plans import linebuild as LB
from logcase.plans.logfiles import logical_name, write_log_files
from logcase.plans.logview import load_log_view, load_table, log_view, with_log_view
from logcase.plans.sizing import even_tasks, spread
from logcase.session import configure, scratch_dir
from logcase.sources.ingest import ingest, manifest
from logcase.sources.store import read_events

QueryFn = Callable[[SparkSession, str], DataFrame]

# Parameters of the checked queries (fixed values chosen for the driver data).
AROUND_AT = "2024-01-15T12:00:00Z"
AROUND_WINDOW_S = 3600
AROUND_SERVICE = "svc-3"
TRACE_ID = "tr_7"
REQUEST_ID = "req_42"
SEARCH_PATTERNS = {
    "search": "r_or k",          # '_' is a wildcard
    "search_wildcard_upper": "VIEW K=1%",   # case-insensitive, '%' wildcard
    "search_backslash": "tr\\_1",           # '\' is an ordinary character: no hit
}


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    """Return timestamp columns in the driver's ``timestamp_ntz`` type."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _rows_ntz(df: DataFrame) -> DataFrame:
    return ntz(df, "ts")


def q_schema_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.describe(load_log_view(spark, sf))
    return ntz(d.select(F.array_join("services", ",").alias("services"),
                        F.array_join("levels", ",").alias("levels"),
                        "ts_min", "ts_max", F.col("n_rows").cast("bigint").alias("n_rows")), "ts_min", "ts_max")


def q_service_levels(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.describe_services(load_log_view(spark, sf))
    return ntz(d.withColumn("n", F.col("n").cast("bigint")), "ts_min", "ts_max")


def q_top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return Q.top_errors(load_log_view(spark, sf), limit=20).withColumn("n", F.col("n").cast("bigint"))


def _search(name: str) -> QueryFn:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rows_ntz(Q.search(load_log_view(spark, sf), SEARCH_PATTERNS[name], limit=10))
    return run


LITERAL_PATTERN = "VIEW K=1"


def q_search_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Literal mode: the pattern is plain text (case-insensitive)."""
    return _rows_ntz(Q.search(load_log_view(spark, sf), LITERAL_PATTERN, limit=10, mode="literal"))


def q_around(spark: SparkSession, sf: str) -> DataFrame:
    return _rows_ntz(Q.around(load_log_view(spark, sf), AROUND_AT, AROUND_WINDOW_S))


def q_around_service(spark: SparkSession, sf: str) -> DataFrame:
    return _rows_ntz(Q.around(load_log_view(spark, sf), AROUND_AT, AROUND_WINDOW_S, service=AROUND_SERVICE))


def q_trace(spark: SparkSession, sf: str) -> DataFrame:
    return _rows_ntz(Q.trace(load_log_view(spark, sf), TRACE_ID))


def q_trace_request(spark: SparkSession, sf: str) -> DataFrame:
    return _rows_ntz(Q.trace(load_log_view(spark, sf), REQUEST_ID))


# Parsing is checked with a fixed fallback time, so results do not depend on "now".
FALLBACK_TS = "1970-01-01T00:00:00Z"
PARSED = ("event_id", "ts", "service", "level", "msg", "format")


def _parse_shape(shape: str) -> QueryFn:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines = LB.shape_lines(load_log_view(spark, sf, even=True), shape)
        return _rows_ntz(parse_lines(lines, fallback_ts=FALLBACK_TS).select(*PARSED))
    return run


def bearer_msg() -> "F.Column":
    """msg with an opaque bearer token appended (built from the row)."""
    return F.concat(F.col("msg"), F.lit(" auth=Bearer "), F.md5(F.col("raw")))


def q_parse_mixed_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All shapes in one column, every message carrying a bearer token."""
    view = load_log_view(spark, sf, even=True)
    lines = view.select("event_id", LB.mixed_line(bearer_msg()).alias("value"))
    return _rows_ntz(parse_lines(lines, fallback_ts=FALLBACK_TS).select(*PARSED))


def _ingested(spark: SparkSession, sf: str):
    view = load_log_view(spark, sf, even=True)
    path = write_log_files(view, LB.mixed_line(bearer_msg()), "logs")
    # a few large gzip files, one task each: their lines are dealt to all tasks before they are parsed
    return ingest(spark, [path], fallback_ts=FALLBACK_TS, rebalance=True)


def q_ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Log view -> gzip NDJSON files (all shapes, secrets) -> ingest."""
    events, _ = _ingested(spark, sf)
    return _rows_ntz(events.select(logical_name(F.col("file")).alias("file"), "line", "ts", "service", "level",
                                   "msg", "format"))


def q_stream_ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Same files as ``ingest_files``, ingested by the file stream (ST1)."""
    from logcase.streaming import ingest_stream
    view = load_log_view(spark, sf, even=True)
    path = write_log_files(view, LB.mixed_line(bearer_msg()), "stream-logs")
    sink, ckpt = scratch_dir(spark, "stream-sink"), scratch_dir(spark, "stream-ckpt")
    q = ingest_stream(spark, path, sink, ckpt, fallback_ts=FALLBACK_TS, available_now=True)
    q.awaitTermination()
    events = read_events(spark, sink)
    return _rows_ntz(events.select(logical_name(F.col("file")).alias("file"), "line", "ts", "service", "level",
                                   "msg", "format"))


def q_ingest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    events, listing = _ingested(spark, sf)
    files, _ = manifest(events, listing)
    return ntz(files.select(logical_name(F.col("path")).alias("file"), F.col("rows").cast("bigint").alias("rows"),
                            "ts_min", "ts_max"), "ts_min", "ts_max")


# Grading cases derived from events: one case per user; the report cites the
# user's error and purchase events (errors as key evidence); the ground truth
# is the user's errors with value >= 10; distractors are errors and views with
# value < 3; confidence = min(errors, 10) / 10.
def _grading_inputs(spark: SparkSession, sf: str):
    e = load_table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").cast("string").alias("event_id"),
        "event_type", "value")
    report = e.where(F.col("event_type").isin("error", "purchase")).select(
        "case_id", "event_id", (F.col("event_type") == "error").alias("is_key"))
    truth = e.where((F.col("event_type") == "error") & (F.col("value") >= 10)).select("case_id", "event_id")
    distractors = e.where(F.col("event_type").isin("error", "view") & (F.col("value") < 3)).select(
        "case_id", "event_id")
    cases = e.groupBy("case_id").agg(
        (F.least(F.count_if(F.col("event_type") == "error"), F.lit(10)) / 10.0).alias("confidence"),
        F.when(F.max((F.col("event_type") == "error").cast("int")) == 1, "submitted")
         .otherwise("max_iterations").alias("termination_reason"),
        (F.max(F.col("event_type").isin("error", "purchase").cast("int")) == 1).alias("has_report"))
    return cases, report, truth, distractors


def q_grade_cases(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    cases, report, truth, distractors = _grading_inputs(spark, sf)
    return G.grade(cases, G.set_counts(report, truth, distractors))


def q_evidence_context(spark: SparkSession, sf: str) -> DataFrame:
    """±3 lines of context for every error line of the log view."""
    view = load_log_view(spark, sf)
    ev = view.where(F.col("level") == "error").select(F.col("event_id").alias("evidence_id"), "file", "line")
    ctx = G.evidence_context(ev, view, k=3)
    return ctx.select("evidence_id", F.array_join("context_before", "|").alias("context_before"),
                      F.array_join("context_after", "|").alias("context_after"))


def q_around_many(spark: SparkSession, sf: str) -> DataFrame:
    """Events within ±60 s of every error event."""
    view = load_log_view(spark, sf)
    anchors = view.where(F.col("level") == "error").select(F.col("event_id").alias("anchor_id"),
                                                           F.col("ts").alias("anchor_ts"))
    return ntz(Q.around_many(view, anchors, 60), "anchor_ts", "ts")


def q_trace_many(spark: SparkSession, sf: str) -> DataFrame:
    """All events of every trace id seen on an error event."""
    view = load_log_view(spark, sf)
    ids = view.where(F.col("level") == "error").select(F.get_json_object("raw", "$.trace_id").alias("id"))
    return _rows_ntz(Q.trace_many(view, ids))


# Secret injected into each document, by doc_id mod 9 (8 = none). Key heads are
# split so that secret scanners do not flag this file.
def _injected_secret() -> "F.Column":
    h = F.md5(F.col("text"))
    nl = F.lit("\n")
    kinds = [
        F.concat(F.lit(" Bearer "), h),
        F.concat(F.lit(" sk_" + "live_"), h),
        F.concat(F.lit(" sk_" + "test_"), h),
        F.concat(F.lit(" AK" + "IA"), F.upper(F.substring(h, 1, 16))),
        F.concat(F.lit(" ey" + "J"), h, F.lit("."), h, F.lit("."), h),
        F.concat(F.lit(" -----BEGIN RSA PRIV" + "ATE KEY-----"), nl, h, nl, F.lit("-----END RSA PRIV" + "ATE KEY-----")),
        F.concat(F.lit(" gh" + "p_"), h),
        F.concat(F.lit(" xo" + "xb-"), h),
    ]
    k = F.col("doc_id") % 9
    out = F.when(k == 0, kinds[0])
    for i, e in enumerate(kinds[1:], start=1):
        out = out.when(k == i, e)
    return out.otherwise(F.lit(""))


def _injected_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(load_table(spark, sf, "documents"))
    return docs.select("doc_id", F.concat(F.col("text"), _injected_secret(), F.lit(" tail")).alias("line"))


def q_redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts with an injected secret, redacted."""
    configure(spark)
    d = _injected_documents(spark, sf)
    return d.select("doc_id", redact(F.col("line")).alias("redacted"))


def q_error_counts_windows(spark: SparkSession, sf: str) -> DataFrame:
    """ST2's windowed error/warn counts (1-hour windows) on the whole log view."""
    from logcase.streaming import error_counts_stream
    out = error_counts_stream(load_log_view(spark, sf), window="1 hour", watermark="1 hour")
    return ntz(out.withColumn("n", F.col("n").cast("bigint")), "window_start", "window_end")


def _case_doc() -> "F.Column":
    """One case-file document per log-view row. Info rows cite an unknown tool
    and values above 100 give a confidence above 1: both must be reported."""
    iso = LB.iso_text(F.col("ts"))
    tool = F.when(F.col("level") == "error", "search").when(F.col("level") == "warn", "trace").otherwise("bogus_tool")
    evidence = F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("file").alias("file"),
                        F.col("line").alias("line"), iso.alias("ts"), F.col("service").alias("service"),
                        F.col("level").alias("level"), F.col("msg").alias("text_redacted"), F.lit("cited").alias("why"),
                        (F.col("level") == "error").alias("is_key"))
    doc = F.struct(
        F.lit("0.1").alias("version"), F.concat(F.lit("why "), F.col("msg")).alias("question"),
        F.struct(F.lit("mock").alias("provider"), F.col("service").alias("name")).alias("model"),
        F.struct(F.array(F.struct(F.col("file").alias("path"), (F.col("line") * 100).alias("bytes"),
                                  F.col("line").alias("rows"), F.md5(F.col("raw")).alias("sha256"))).alias("files"),
                 F.struct(iso.alias("start"), iso.alias("end")).alias("time_window"),
                 F.col("line").alias("total_rows")).alias("logs_manifest"),
        F.array(F.struct(F.lit(1).alias("step"), tool.alias("tool"),
                         F.struct(F.col("msg").alias("pattern")).alias("args"),
                         F.col("line").alias("elapsed_ms"))).alias("trajectory"),
        F.struct(F.col("msg").alias("root_cause"), F.col("service").alias("blast_radius"),
                 F.array(evidence).alias("evidence"), F.lit("fix").alias("remediation"),
                 (F.col("value") / 100.0).alias("confidence"), F.lit("derived").alias("confidence_rationale"))
         .alias("report"),
        F.lit("submitted").alias("termination_reason"))
    return F.to_json(doc)


def case_document(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, text): one case file per event."""
    configure(spark)
    events = load_table(spark, sf, "events")
    n = even_tasks(events)
    ev = events.select("event_id", "value").repartition(n, "event_id")
    view = log_view(events).repartition(n, "event_id").join(ev, "event_id")
    return view.select(F.col("event_id").alias("case_id"), _case_doc().alias("text"))


def _case_files(spark: SparkSession, sf: str) -> DataFrame:
    from logcase.operators.casefile import parse_cases, validate_cases
    return validate_cases(parse_cases(case_document(spark, sf)))


def q_case_steps(spark: SparkSession, sf: str) -> DataFrame:
    """V3 replay rows (with the args preview) of the per-event case files."""
    from logcase.operators.casefile import case_steps
    st = case_steps(_case_files(spark, sf))
    return st.select("case_id", F.col("pos").cast("bigint").alias("pos"), "step", "tool", "args_preview",
                     "elapsed_ms")


def q_case_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """V4 evidence rows of the per-event case files."""
    from logcase.operators.casefile import case_evidence
    e = case_evidence(_case_files(spark, sf))
    return ntz(e.select("case_id", "event_id", "file", "line", "ts", "service", "level", "text_redacted",
                        "is_key", F.size("context_before").cast("bigint").alias("n_before")), "ts")


def q_case_files(spark: SparkSession, sf: str) -> DataFrame:
    """Case-file documents built from the events: parse, validate, summarise."""
    from logcase.operators.casefile import case_summary
    summ = case_summary(_case_files(spark, sf))
    return summ.select("case_id", "valid", F.array_join("violations", ",").alias("violations"), "sealed",
                       F.col("n_steps").cast("bigint").alias("n_steps"), "confidence",
                       F.col("confidence_pct").cast("bigint").alias("confidence_pct"), "confidence_band",
                       F.col("n_key_evidence").cast("bigint").alias("n_key_evidence"),
                       F.col("n_evidence").cast("bigint").alias("n_evidence"), "blast_radius_type")


def q_document_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Q6 display cut (100 characters + ellipsis) of every redacted document."""
    from logcase.functions.display import msg_short
    red = q_redact_documents(spark, sf)
    return red.select("doc_id", msg_short(F.col("redacted"), 100).alias("preview"),
                      F.length("redacted").cast("bigint").alias("n_chars"))


def q_redaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per pattern: rows still holding a secret (0) and rows with its marker."""
    red = q_redact_documents(spark, sf).select(F.col("redacted").alias("msg"))
    return redaction_audit(red, cols=("msg",)).select(
        F.col("pattern_order").cast("bigint").alias("pattern_order"), "pattern",
        F.col("leaked_rows").cast("bigint").alias("leaked_rows"),
        F.col("redacted_rows").cast("bigint").alias("redacted_rows"))


ROWS = "ts, service, level, msg, file, line"


def _like_sql(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT {ROWS} FROM log_events WHERE msg ILIKE '%{p}%' OR raw ILIKE '%{p}%' ORDER BY ts, file, line LIMIT 10"


def _around_sql(service: str | None) -> str:
    t = AROUND_AT.replace("T", " ").replace("Z", "")
    cond = f"ts BETWEEN TIMESTAMP '{t}' - INTERVAL {AROUND_WINDOW_S} SECOND AND TIMESTAMP '{t}' + INTERVAL {AROUND_WINDOW_S} SECOND"
    if service:
        cond += f" AND service = '{service}'"
    return f"SELECT {ROWS} FROM log_events WHERE {cond} ORDER BY ts, file, line"


def _trace_sql(tid: str) -> str:
    return (f"SELECT {ROWS} FROM log_events WHERE json_extract_string(raw, '$.trace_id') = '{tid}' "
            f"OR json_extract_string(raw, '$.request_id') = '{tid}' ORDER BY ts, file, line")


QUERIES: dict[str, QueryFn] = {
    "schema_summary": q_schema_summary,
    "service_levels": q_service_levels,
    "top_errors": q_top_errors,
    **{name: _search(name) for name in SEARCH_PATTERNS},
    "search_literal": q_search_literal,
    "around": q_around,
    "around_service": q_around_service,
    "trace": q_trace,
    "trace_request": q_trace_request,
    **{f"parse_{shape}": _parse_shape(shape) for shape in LB.SHAPES},
    "parse_mixed_redacted": q_parse_mixed_redacted,
    "redact_documents": q_redact_documents,
    "ingest_files": q_ingest_files,
    "grade_cases": q_grade_cases,
    "evidence_context": q_evidence_context,
    "around_many": q_around_many,
    "trace_many": q_trace_many,
    "ingest_manifest": q_ingest_manifest,
    "stream_ingest_files": q_stream_ingest_files,
    "redaction_audit": q_redaction_audit,
    "document_previews": q_document_previews,
    "error_counts_windows": q_error_counts_windows,
    "case_files": q_case_files,
    "case_steps": q_case_steps,
    "case_evidence": q_case_evidence,
}

_SHAPE_FORMAT = {"splunk_wrapped": "splunk", "splunk_flat": "splunk", "datadog": "datadog",
                 "datadog_legacy": "datadog", "newrelic": "newrelic", "honeycomb": "honeycomb",
                 "generic": "generic", "plaintext": "text"}


def _parse_sql(shape: str) -> str:
    fmt = _SHAPE_FORMAT[shape]
    if shape == "newrelic":
        return f"SELECT event_id, date_trunc('millisecond', ts) AS ts, service, level, msg, '{fmt}' AS format FROM log_events"
    if shape == "plaintext":
        return ("SELECT event_id, ts, 'unknown' AS service, 'info' AS level, "
                "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || upper(level) || ' ' || service || ' ' || msg AS msg, "
                f"'{fmt}' AS format FROM log_events")
    return f"SELECT event_id, ts, service, level, msg, '{fmt}' AS format FROM log_events"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# What counts as a secret, written out for DuckDB apart from the product's own list (name, pattern, replacement; in
# order of application), so that a wrong pattern there cannot agree with itself here.
_SECRETS_SQL = (
    ("bearer", r"Bearer\s+[\w.~+/=-]{16,}", "Bearer [REDACTED_BEARER]"),
    ("stripe_live", r"sk_live_[[:alnum:]]{16,}", "[REDACTED_STRIPE_KEY]"),
    ("stripe_test", r"sk_test_[[:alnum:]]{16,}", "[REDACTED_STRIPE_TEST_KEY]"),
    ("aws_access_key", r"AKIA[A-Z\d]{16}", "[REDACTED_AWS_ACCESS_KEY]"),
    ("jwt", r"eyJ[\w=-]{10,}[.][\w=-]{10,}[.][\w.+/=-]{10,}", "[REDACTED_JWT]"),
    ("private_key", r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----.+?-----END [A-Z ]+PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("github_token", r"ghp_[[:alnum:]]{30,}", "[REDACTED_GITHUB_TOKEN]"),
    ("slack_token", r"xox[abprs]-[[:alnum:]-]{10,}", "[REDACTED_SLACK_TOKEN]"),
)


def _redact_sql(expr: str) -> str:
    for _, pattern, marker in _SECRETS_SQL:
        expr = f"regexp_replace({expr}, {_sql_str(pattern)}, {_sql_str(marker)}, 'g')"
    return expr


_MIXED_FORMAT_SQL = ("CASE WHEN level = 'error' THEN 'splunk' WHEN level = 'warn' THEN 'datadog' "
                     "WHEN msg LIKE 'view %' THEN 'newrelic' WHEN msg LIKE 'click %' THEN 'honeycomb' "
                     "ELSE 'generic' END")

_MIXED_TS_SQL = "CASE WHEN msg LIKE 'view %' THEN date_trunc('millisecond', ts) ELSE ts END"

_INJECTED_SQL = """
SELECT doc_id, text || CASE doc_id % 9
    WHEN 0 THEN ' Bearer ' || md5(text)
    WHEN 1 THEN ' sk_' || 'live_' || md5(text)
    WHEN 2 THEN ' sk_' || 'test_' || md5(text)
    WHEN 3 THEN ' AK' || 'IA' || upper(substr(md5(text), 1, 16))
    WHEN 4 THEN ' ey' || 'J' || md5(text) || '.' || md5(text) || '.' || md5(text)
    WHEN 5 THEN ' -----BEGIN RSA PRIV' || 'ATE KEY-----' || chr(10) || md5(text) || chr(10) || '-----END RSA PRIV' || 'ATE KEY-----'
    WHEN 6 THEN ' gh' || 'p_' || md5(text)
    WHEN 7 THEN ' xo' || 'xb-' || md5(text)
    ELSE '' END || ' tail' AS line
FROM documents
"""


def _audit_sql() -> str:
    parts = []
    for i, (name, pattern, marker) in enumerate(_SECRETS_SQL):
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS pattern_order, '{name}' AS pattern, "
            f"CAST(count_if(regexp_matches(redacted, {_sql_str(pattern)})) AS BIGINT) AS leaked_rows, "
            f"CAST(count_if(contains(redacted, {_sql_str(marker)})) AS BIGINT) AS redacted_rows FROM red")
    return (f"WITH inj AS ({_INJECTED_SQL}), red AS (SELECT doc_id, {_redact_sql('line')} AS redacted FROM inj)\n"
            + "\nUNION ALL\n".join(parts))


_GRADE_SQL = """
WITH e AS (SELECT user_id AS case_id, CAST(event_id AS VARCHAR) AS event_id, event_type, value FROM events),
rep AS (SELECT DISTINCT case_id, event_id, event_type = 'error' AS is_key FROM e WHERE event_type IN ('error', 'purchase')),
tru AS (SELECT DISTINCT case_id, event_id FROM e WHERE event_type = 'error' AND value >= 10),
dis AS (SELECT DISTINCT case_id, event_id FROM e WHERE event_type IN ('error', 'view') AND value < 3),
cases AS (SELECT case_id, least(count_if(event_type = 'error'), 10) / 10.0 AS confidence,
                 CASE WHEN bool_or(event_type = 'error') THEN 'submitted' ELSE 'max_iterations' END AS termination_reason,
                 bool_or(event_type IN ('error', 'purchase')) AS has_report FROM e GROUP BY case_id),
nr AS (SELECT case_id, count(*) AS n FROM rep GROUP BY case_id),
nt AS (SELECT case_id, count(*) AS n FROM tru GROUP BY case_id),
nh AS (SELECT r.case_id, count(*) AS n FROM rep r JOIN tru t USING (case_id, event_id) GROUP BY r.case_id),
nd AS (SELECT r.case_id, count(*) AS n FROM rep r JOIN dis d USING (case_id, event_id) WHERE r.is_key GROUP BY r.case_id),
g AS (SELECT c.*, CAST(coalesce(nr.n, 0) AS BIGINT) AS n_report, CAST(coalesce(nt.n, 0) AS BIGINT) AS n_truth,
             CAST(coalesce(nh.n, 0) AS BIGINT) AS n_hits, CAST(coalesce(nd.n, 0) AS BIGINT) AS n_key_distractor_hits
      FROM cases c LEFT JOIN nr USING (case_id) LEFT JOIN nt USING (case_id) LEFT JOIN nh USING (case_id)
      LEFT JOIN nd USING (case_id)),
s AS (SELECT *, CASE WHEN n_truth = 0 THEN 1.0 ELSE n_hits / n_truth END AS overlap_recall,
             CASE WHEN n_report + n_truth - n_hits = 0 THEN 1.0 ELSE n_hits / (n_report + n_truth - n_hits) END AS overlap_jaccard
      FROM g)
SELECT case_id, n_report, n_truth, n_hits, n_truth - n_hits AS n_misses, n_key_distractor_hits,
       overlap_recall, overlap_jaccard, overlap_recall >= 0.5 AS overlap_ok, n_key_distractor_hits <= 0 AS distractor_ok,
       coalesce(confidence >= 0.5, false) AS confidence_ok,
       coalesce(has_report, false) AND termination_reason = 'submitted' AND overlap_recall >= 0.5
         AND n_key_distractor_hits <= 0 AND coalesce(confidence >= 0.5, false) AS passed
FROM s
"""

_CONTEXT_SQL = """
SELECT e.event_id AS evidence_id,
  coalesce((SELECT string_agg(x.msg, '|' ORDER BY x.line) FROM log_events x
            WHERE x.file = e.file AND x.line BETWEEN e.line - 3 AND e.line - 1), '') AS context_before,
  coalesce((SELECT string_agg(x.msg, '|' ORDER BY x.line) FROM log_events x
            WHERE x.file = e.file AND x.line BETWEEN e.line + 1 AND e.line + 3), '') AS context_after
FROM log_events e WHERE e.level = 'error'
"""

_AROUND_MANY_SQL = """
SELECT a.event_id AS anchor_id, a.ts AS anchor_ts, e.ts, e.service, e.level, e.msg, e.file, e.line
FROM log_events a JOIN log_events e
  ON e.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND
WHERE a.level = 'error'
"""

_TRACE_MANY_SQL = """
WITH ids AS (SELECT DISTINCT json_extract_string(raw, '$.trace_id') AS id FROM log_events WHERE level = 'error'),
keyed AS (SELECT DISTINCT x.id, l.ts, l.service, l.level, l.msg, l.file, l.line
          FROM log_events l, (SELECT json_extract_string(raw, '$.trace_id') AS id, file, line FROM log_events
                              UNION SELECT json_extract_string(raw, '$.request_id'), file, line FROM log_events) x
          WHERE x.file = l.file AND x.line = l.line AND x.id IS NOT NULL)
SELECT k.id, k.ts, k.service, k.level, k.msg, k.file, k.line FROM keyed k JOIN ids USING (id)
"""

ORACLE_SQL: dict[str, str] = {
    "schema_summary": with_log_view(
        "SELECT string_agg(DISTINCT service, ',' ORDER BY service) AS services, "
        "string_agg(DISTINCT level, ',' ORDER BY level) AS levels, "
        "min(ts) AS ts_min, max(ts) AS ts_max, CAST(count(*) AS BIGINT) AS n_rows FROM log_events"),
    "service_levels": with_log_view(
        "SELECT service, level, CAST(count(*) AS BIGINT) AS n, min(ts) AS ts_min, max(ts) AS ts_max "
        "FROM log_events GROUP BY service, level"),
    "top_errors": with_log_view(
        "SELECT service, level, msg, CAST(count(*) AS BIGINT) AS n FROM log_events "
        "WHERE level IN ('error', 'warn') GROUP BY service, level, msg "
        "ORDER BY n DESC, service, level, msg LIMIT 20"),
    **{name: with_log_view(_like_sql(p)) for name, p in SEARCH_PATTERNS.items()},
    "search_literal": with_log_view(
        f"SELECT {ROWS} FROM log_events WHERE contains(lower(msg), lower('{LITERAL_PATTERN}')) "
        f"OR contains(lower(raw), lower('{LITERAL_PATTERN}')) ORDER BY ts, file, line LIMIT 10"),
    "around": with_log_view(_around_sql(None)),
    "around_service": with_log_view(_around_sql(AROUND_SERVICE)),
    "trace": with_log_view(_trace_sql(TRACE_ID)),
    "trace_request": with_log_view(_trace_sql(REQUEST_ID)),
    **{f"parse_{shape}": with_log_view(_parse_sql(shape)) for shape in LB.SHAPES},
    "parse_mixed_redacted": with_log_view(
        "SELECT event_id, " + _MIXED_TS_SQL + " AS ts, service, level, "
        + _redact_sql("msg || ' auth=Bearer ' || md5(raw)")
        + f" AS msg, {_MIXED_FORMAT_SQL} AS format FROM log_events"),
    "grade_cases": _GRADE_SQL,
    "evidence_context": with_log_view(_CONTEXT_SQL),
    "around_many": with_log_view(_AROUND_MANY_SQL),
    "trace_many": with_log_view(_TRACE_MANY_SQL),
    "ingest_files": with_log_view(
        "SELECT replace(file, 'logs/', '') AS file, line, " + _MIXED_TS_SQL + " AS ts, service, level, "
        + _redact_sql("msg || ' auth=Bearer ' || md5(raw)") + f" AS msg, {_MIXED_FORMAT_SQL} AS format FROM log_events"),
    "stream_ingest_files": None,
    "ingest_manifest": with_log_view(
        "SELECT replace(file, 'logs/', '') AS file, CAST(count(*) AS BIGINT) AS rows, "
        f"min({_MIXED_TS_SQL}) AS ts_min, max({_MIXED_TS_SQL}) AS ts_max FROM log_events GROUP BY 1"),
    "redact_documents": f"WITH inj AS ({_INJECTED_SQL}) SELECT doc_id, {_redact_sql('line')} AS redacted FROM inj",
    "redaction_audit": _audit_sql(),
}
ORACLE_SQL["stream_ingest_files"] = ORACLE_SQL["ingest_files"]
ORACLE_SQL["error_counts_windows"] = with_log_view(
    "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, "
    "service, level, msg, CAST(count(*) AS BIGINT) AS n FROM log_events WHERE level IN ('error', 'warn') "
    "GROUP BY ALL")
ORACLE_SQL["case_files"] = with_log_view("""
SELECT l.event_id AS case_id,
  NOT (e.value / 100.0 > 1 OR l.level NOT IN ('error', 'warn')) AS valid,
  concat_ws(',', CASE WHEN e.value / 100.0 > 1 THEN 'range:report.confidence' END,
                 CASE WHEN l.level NOT IN ('error', 'warn') THEN 'enum:trajectory[0].tool=bogus_tool' END) AS violations,
  true AS sealed, CAST(1 AS BIGINT) AS n_steps, e.value / 100.0 AS confidence,
  CAST(round(e.value / 100.0 * 100) AS BIGINT) AS confidence_pct,
  CASE WHEN e.value / 100.0 >= 0.8 THEN 'ok' WHEN e.value / 100.0 >= 0.5 THEN 'warn' ELSE 'err' END AS confidence_band,
  CAST(CASE WHEN l.level = 'error' THEN 1 ELSE 0 END AS BIGINT) AS n_key_evidence, CAST(1 AS BIGINT) AS n_evidence,
  'STRING' AS blast_radius_type
FROM log_events l JOIN events e USING (event_id)
""")
ORACLE_SQL["case_steps"] = with_log_view(
    "SELECT event_id AS case_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS step, "
    "CASE level WHEN 'error' THEN 'search' WHEN 'warn' THEN 'trace' ELSE 'bogus_tool' END AS tool, "
    "'pattern=' || msg AS args_preview, line AS elapsed_ms FROM log_events")
ORACLE_SQL["case_evidence"] = with_log_view(
    "SELECT event_id AS case_id, CAST(event_id AS VARCHAR) AS event_id, file, line, ts, service, level, "
    "msg AS text_redacted, level = 'error' AS is_key, CAST(0 AS BIGINT) AS n_before FROM log_events")
ORACLE_SQL["document_previews"] = (
    f"WITH inj AS ({_INJECTED_SQL}), red AS (SELECT doc_id, {_redact_sql('line')} AS redacted FROM inj) "
    "SELECT doc_id, CASE WHEN length(redacted) > 100 THEN substr(redacted, 1, 100) || '…' ELSE redacted END "
    "AS preview, CAST(length(redacted) AS BIGINT) AS n_chars FROM red")


# Extra registered queries timed by bench.py.
BENCH_EXTRA = ("grade_cases", "evidence_context", "around_many", "trace_many")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_top_errors(spark, sf)

"""Case files: typed reading, strict validation, flattening, summaries.

A case file is one JSON document per investigation run. ``CASE_SCHEMA``
gives the typed view; validation walks the VARIANT of the same text against a rule table
(``caserules``), so that unknown keys, wrong types and enum violations are seen (V1/V2). A row
is never dropped: it carries its ``violations`` (empty when valid).
Unions (``blast_radius`` string or object, open ground-truth fields) are
VARIANT columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logcase.functions.display import args_preview, confidence_band, confidence_pct
from logcase.functions.jsonvals import MOST_JSON_BYTES, strict_value, too_large
from logcase.operators import grading as G
from logcase.operators.caserules import CASE_VERSION, DEFAULT_TEMPERATURE, MAX_CONTEXT_LINES, staged, with_violations

_EVIDENCE = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("service", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("text_redacted", T.StringType()),
    T.StructField("context_before", T.ArrayType(T.StringType())),
    T.StructField("context_after", T.ArrayType(T.StringType())),
    T.StructField("why", T.StringType()), T.StructField("is_key", T.BooleanType()),
])
CASE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("model", T.StructType([T.StructField("provider", T.StringType()),
                                         T.StructField("name", T.StringType()),
                                         T.StructField("temperature", T.DoubleType())])),
    T.StructField("logs_manifest", T.StructType([
        T.StructField("files", T.ArrayType(T.StructType([
            T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()),
            T.StructField("rows", T.LongType()), T.StructField("sha256", T.StringType())]))),
        T.StructField("time_window", T.StructType([T.StructField("start", T.TimestampType()),
                                                   T.StructField("end", T.TimestampType())])),
        T.StructField("total_rows", T.LongType())])),
    T.StructField("trajectory", T.ArrayType(T.StructType([
        T.StructField("step", T.LongType()), T.StructField("tool", T.StringType()),
        T.StructField("args", T.VariantType()), T.StructField("stdout_excerpt", T.StringType()),
        T.StructField("stderr_excerpt", T.StringType()), T.StructField("elapsed_ms", T.LongType()),
        T.StructField("report_delta", T.VariantType())]))),
    T.StructField("report", T.StructType([
        T.StructField("root_cause", T.StringType()), T.StructField("blast_radius", T.VariantType()),
        T.StructField("evidence", T.ArrayType(_EVIDENCE)), T.StructField("remediation", T.StringType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("confidence_rationale", T.StringType()),
        T.StructField("unknowns", T.ArrayType(T.StringType()))])),
    T.StructField("termination_reason", T.StringType()),
    T.StructField("usage", T.StructType([
        T.StructField("llm_calls", T.LongType()), T.StructField("tool_calls", T.LongType()),
        T.StructField("wall_clock_s", T.DoubleType()), T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType())])),
    T.StructField("ground_truth", T.VariantType()),
])
GROUND_TRUTH_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()), T.StructField("root_cause", T.StringType()),
    T.StructField("evidence_event_ids", T.ArrayType(T.StringType())),
    T.StructField("blast_radius", T.VariantType()), T.StructField("remediation", T.VariantType()),
    T.StructField("distractors", T.ArrayType(T.VariantType())),
])


def parse_cases(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``doc`` (variant) and ``case`` (typed struct) from JSON text; both
    null when the text is not exactly one JSON value. A document beyond what
    VARIANT can hold raises an error."""
    value, text = strict_value(F.col(text_col)), F.col(text_col)
    refused = F.raise_error(F.lit(f"a case file of more than {MOST_JSON_BYTES} bytes cannot be parsed"))
    return docs.withColumn("doc", F.when(too_large(text, value), refused).otherwise(value)) \
        .withColumn("case", F.when(F.col("doc").isNotNull(), F.from_json(F.col(text_col), CASE_SCHEMA)))


def validate_cases(cases: DataFrame) -> DataFrame:
    """Add ``violations`` and ``valid``; fill the protocol defaults in ``case``
    (temperature 0.2, unknowns [], is_key false, usage zeros). A filter on the result does not repeat the walk."""
    c = F.col("case")
    ev = F.transform(c["report"]["evidence"], lambda e: e.withField("is_key", F.coalesce(e["is_key"], F.lit(False)))
                     .withField("context_before", F.coalesce(e["context_before"], F.array().cast("array<string>")))
                     .withField("context_after", F.coalesce(e["context_after"], F.array().cast("array<string>"))))
    report = F.when(c["report"].isNotNull(), c["report"].withField("evidence", ev).withField(
        "unknowns", F.coalesce(c["report"]["unknowns"], F.array().cast("array<string>"))))
    usage = F.struct(*[F.coalesce(c["usage"][k], F.lit(0).cast(t)).alias(k) for k, t in
                       (("llm_calls", "bigint"), ("tool_calls", "bigint"), ("wall_clock_s", "double"),
                        ("input_tokens", "bigint"), ("output_tokens", "bigint"))])
    filled = (c.withField("version", F.coalesce(c["version"], F.lit(CASE_VERSION)))
              .withField("model", c["model"].withField("temperature", F.coalesce(c["model"]["temperature"],
                                                                                 F.lit(DEFAULT_TEMPERATURE))))
              .withField("report", report).withField("usage", usage))
    judged = with_violations(cases)
    return staged(judged, valid=F.size("violations") == 0, _case=filled).drop("case").withColumnRenamed("_case", "case").select(
        *cases.columns, "violations", "valid")


def case_steps(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """V3: one row per trajectory step, in order (replay)."""
    s = cases.select(id_col, F.posexplode(F.col("case.trajectory")).alias("pos", "s"))
    return s.select(id_col, "pos", F.col("s.step").alias("step"), F.col("s.tool").alias("tool"),
                    args_preview(F.col("s.args")).alias("args_preview"), F.col("s.elapsed_ms").alias("elapsed_ms"),
                    F.col("s.stdout_excerpt").alias("stdout_excerpt"), F.col("s.stderr_excerpt").alias("stderr_excerpt"),
                    F.col("s.report_delta").isNotNull().alias("has_report_delta"))


def case_evidence(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """V4: one row per cited line (cases without evidence keep one null row)."""
    e = cases.select(id_col, F.posexplode_outer(F.col("case.report.evidence")).alias("pos", "e"))
    return e.select(id_col, "pos", "e.*")


def case_summary(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """One row per case for a listing page. Columns ``valid`` and
    ``violations`` are carried along when there."""
    c, ev = F.col("case"), F.col("case.report.evidence")
    conf = c["report"]["confidence"]
    return cases.select(
        id_col, *[k for k in ("valid", "violations") if k in cases.columns], c["question"].alias("question"),
        (c["termination_reason"] == "submitted").alias("sealed"),
        c["termination_reason"].alias("termination_reason"),
        c["logs_manifest"]["total_rows"].alias("rows"), F.size(c["logs_manifest"]["files"]).alias("n_files"),
        F.size(c["trajectory"]).alias("n_steps"), c["usage"]["llm_calls"].alias("llm_calls"),
        c["usage"]["wall_clock_s"].alias("wall_clock_s"), c["report"]["root_cause"].alias("root_cause"),
        conf.alias("confidence"), confidence_pct(conf).alias("confidence_pct"),
        F.when(conf.isNotNull(), confidence_band(conf)).alias("confidence_band"),
        F.when(ev.isNotNull(), F.size(F.filter(ev, lambda e: F.coalesce(e["is_key"], F.lit(False))))).alias("n_key_evidence"),
        F.when(ev.isNotNull(), F.size(ev)).alias("n_evidence"),
        F.schema_of_variant(c["report"]["blast_radius"]).alias("blast_radius_type"),
        F.substring(c["logs_manifest"]["files"][0]["sha256"], 1, 12).alias("first_file_sha12"))


def parse_ground_truth(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Typed ground truth; distractor ids are the ``event`` field of each
    distractor object."""
    g = docs.withColumn("gt", F.from_json(F.col(text_col), GROUND_TRUTH_SCHEMA))
    return g.withColumn("distractor_ids", F.filter(F.transform(F.col("gt.distractors"),
                        lambda d: F.try_variant_get(d, "$.event", "string")), lambda x: x.isNotNull()))


def attach_truth(cases: DataFrame, truth: DataFrame, key: str = "incident_id") -> DataFrame:
    """Left join of cases to their ground truth on ``key``."""
    return cases.join(truth.select(key, "gt", "distractor_ids"), key, "left")


def evidence_sets(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """J1-J3 on one document each: hit, missed and key-distractor ids (the
    lists of one case file are bounded by the document)."""
    ev = F.col("case.report.evidence")
    report_ids = F.filter(F.transform(ev, lambda e: e["event_id"]), lambda x: x.isNotNull())
    key_ids = F.filter(F.transform(F.filter(ev, lambda e: F.coalesce(e["is_key"], F.lit(False))),
                                   lambda e: e["event_id"]), lambda x: x.isNotNull())
    gt_ids = F.coalesce(F.col("gt.evidence_event_ids"), F.array().cast("array<string>"))
    return cases.select(id_col,
                        F.array_intersect(F.array_distinct(report_ids), gt_ids).alias("hits"),
                        F.array_except(gt_ids, F.coalesce(report_ids, F.array().cast("array<string>"))).alias("misses"),
                        F.array_intersect(F.array_distinct(key_ids), F.coalesce(F.col("distractor_ids"),
                                          F.array().cast("array<string>"))).alias("distractor_hits"),
                        G.jaccard(F.coalesce(report_ids, F.array().cast("array<string>")), gt_ids).alias("jaccard"))


def grade_case_files(cases: DataFrame, id_col: str = "case_id", empty_truth_overlap: float = 1.0) -> DataFrame:
    """G1-G5 for case files with attached truth, through the long-form counts.
    A case that failed validation (``valid`` false) does not pass."""
    valid = F.col("valid") if "valid" in cases.columns else F.lit(True)
    c = cases.select(F.col(id_col).alias("case_id"), "case", "gt", "distractor_ids", valid.alias("_valid"))
    report = c.select("case_id", F.explode(F.col("case.report.evidence")).alias("e")).select(
        "case_id", F.col("e.event_id").alias("event_id"), F.coalesce(F.col("e.is_key"), F.lit(False)).alias("is_key"))
    truth = c.select("case_id", F.explode(F.col("gt.evidence_event_ids")).alias("event_id"))
    distr = c.select("case_id", F.explode(F.col("distractor_ids")).alias("event_id"))
    meta = c.select("case_id", F.col("case.report.confidence").alias("confidence"),
                    F.col("case.termination_reason").alias("termination_reason"),
                    (F.col("case.report").isNotNull() & F.col("_valid")).alias("has_report"))
    return G.grade(meta, G.set_counts(report, truth, distr), empty_truth_overlap)


def usage_totals(cases: DataFrame) -> DataFrame:
    """Run usage summed over many case files, per model."""
    u = F.col("case.usage")
    return cases.groupBy(F.col("case.model.provider").alias("provider"), F.col("case.model.name").alias("model")) \
        .agg(F.count(F.lit(1)).alias("n_cases"),
             *[F.sum(F.coalesce(u[k], F.lit(0))).alias(k)
               for k in ("llm_calls", "tool_calls", "wall_clock_s", "input_tokens", "output_tokens")])


def case_evidence_with_context(cases: DataFrame, events: DataFrame, store_prefix: str = "",
                               k: int = MAX_CONTEXT_LINES, id_col: str = "case_id") -> DataFrame:
    """J4 on case files: each cited line with up to ``k`` store lines before
    and after it. Evidence paths are relative; ``store_prefix`` + path must
    equal the store's ``file``. One row per citation (flat, so any number
    of cases and citations scales)."""
    ev = case_evidence(cases, id_col).where(F.col("file").isNotNull())
    ev = ev.withColumn("evidence_id", F.concat_ws("#", F.col(id_col).cast("string"), F.col("pos").cast("string")))
    cited = ev.select("evidence_id", F.concat(F.lit(store_prefix), F.col("file")).alias("file"), "line")
    ctx = G.evidence_context(cited, events, k)
    return ev.drop("context_before", "context_after").join(ctx, "evidence_id", "left").drop("evidence_id")

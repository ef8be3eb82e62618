"""Case files: reading, validation, flattening, summaries, grading."""
import pytest
from pyspark.sql import functions as F

import casedocs
import incident
from logcase.operators.casefile import (attach_truth, case_evidence, case_evidence_with_context, case_steps,
                                        case_summary, evidence_sets, grade_case_files, usage_totals,
                                        validate_cases)
from logcase.sources.ingest import ingest
from logcase.sources.casefiles import read_cases, read_ground_truth, write_cases


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cases")
    cases_dir, gt = casedocs.write(d)
    cases = validate_cases(read_cases(spark, [str(cases_dir)])).withColumn("incident_id", F.lit(casedocs.INCIDENT_ID))
    truth = read_ground_truth(spark, [str(gt)])
    return attach_truth(cases, truth).cache(), d


def by_id(df, col="case_id"):
    return {r[col]: r for r in df.collect()}


def test_validation(docs):
    cases, _ = docs
    v = {k: r.violations for k, r in by_id(cases).items()}
    assert v["good"] == [] and v["distractor"] == [] and v["noreport"] == [] and v["objblast"] == []
    bad = set(v["invalid"])
    assert "unknown_key:case:surprise" in bad
    assert "range:report.confidence" in bad
    assert "max_items:report.evidence[0].context_before" in bad
    assert "enum:trajectory[1].tool=rm_rf" in bad
    assert "missing:model.name" in bad


def test_defaults_and_unions(docs):
    cases, _ = docs
    rows = by_id(cases)
    g = rows["good"].case
    assert g.model.temperature == 0.2 and g.report.unknowns == [] and g.usage.input_tokens == 0
    s = by_id(case_summary(cases))
    assert s["good"].blast_radius_type == "STRING" and s["objblast"].blast_radius_type.startswith("OBJECT")
    assert s["noreport"].confidence is None and s["noreport"].sealed is False
    assert (s["good"].n_key_evidence, s["good"].n_evidence, s["good"].confidence_band) == (2, 3, "warn")
    assert s["good"].confidence_pct == 70 and s["good"].n_steps == 6


def test_steps_and_evidence(docs):
    cases, _ = docs
    steps = case_steps(cases.where(F.col("case_id") == "good")).orderBy("pos").collect()
    assert [s.tool for s in steps][:2] == ["schema", "top_errors"]
    assert steps[1].args_preview == "limit=5"
    ev = case_evidence(cases.where(F.col("case_id").isin("good", "noreport")))
    counts = {r.case_id: r["count"] for r in ev.groupBy("case_id").count().collect()}
    assert counts == {"good": 3, "noreport": 1}


def test_grading(docs):
    cases, _ = docs
    g = by_id(grade_case_files(cases))
    assert g["good"].overlap_recall == pytest.approx(2 / 3) and g["good"].passed
    assert g["good"].overlap_jaccard == pytest.approx(2 / 3)
    assert g["distractor"].n_key_distractor_hits == 1 and not g["distractor"].passed
    assert not g["noreport"].passed and not g["invalid"].passed
    sets = by_id(evidence_sets(cases))
    assert sets["good"].misses == [incident.ROOT_CAUSE_IDS[2]]
    assert sets["distractor"].distractor_hits == [incident.DISTRACTOR_IDS[0]]


def test_write_roundtrip(spark, docs):
    cases, d = docs
    out = str(d / "out")
    write_cases(cases.where(F.col("valid")), out)
    back = spark.read.text(out)
    assert back.count() == 4


def test_usage_totals(docs):
    cases, _ = docs
    (r,) = usage_totals(cases.where(F.col("valid"))).collect()
    assert (r.provider, r.model, r.n_cases, r.llm_calls, r.tool_calls) == ("mock", "scripted", 4, 12, 44)
    assert r.input_tokens == 0 and abs(r.wall_clock_s - 4 * 12.25) < 1e-9


def test_evidence_context_from_store(spark, docs):
    cases, d = docs
    incident.write(d / "logs")
    events, _ = ingest(spark, [str(d / "logs")], fallback_ts="2000-01-01T00:00:00Z")
    good = cases.where(F.col("case_id") == "good")
    rows = {r.pos: r for r in case_evidence_with_context(good, events, store_prefix=str(d) + "/").collect()}
    cfg = [r["msg"] for r in incident.lines_by_service()["archiver"]]
    assert rows[1].context_before == cfg[0:1] and rows[1].context_after == cfg[2:5]
    assert rows[0].context_before == [] and rows[0].context_after == cfg[1:4]

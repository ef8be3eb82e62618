"""Case files that must be refused, and the round trip of many cases."""
import json
import time

import casedocs
import pytest
from pyspark.sql import functions as F

from logcase.operators.casefile import parse_cases, validate_cases
from logcase.sources.casefiles import read_cases, write_cases


def _set(path, value):
    def change(c):
        at = c
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return json.dumps(c)
    return change


BAD = {
    "not_an_object": lambda c: json.dumps(c) + " x",
    "type:case.model": _set(["model"], "gpt"),
    "type:case.logs_manifest": _set(["logs_manifest"], 5),
    "null:case.question": _set(["question"], None),
    "type:case.question": _set(["question"], 5),
    "type:case.usage": _set(["usage"], [1]),
    "type:logs_manifest.files": _set(["logs_manifest", "files"], "x"),
    "type:report.evidence": _set(["report", "evidence"], "x"),
    "type:report.blast_radius": _set(["report", "blast_radius"], 3),
    "type:logs_manifest.total_rows": _set(["logs_manifest", "total_rows"], "abc"),
    "type:case.ground_truth": _set(["ground_truth"], "x"),
    "type:trajectory[1].step": _set(["trajectory", 1, "step"], "x"),
    "type:logs_manifest.time_window.start": _set(["logs_manifest", "time_window", "start"], "never"),
    "type:trajectory[0]": _set(["trajectory", 0], 7),
    "type:report.unknowns": _set(["report", "unknowns"], ["a", 1]),
    "null:case.usage": _set(["usage"], None),
    "type:usage.llm_calls": _set(["usage", "llm_calls"], 2.5),
    "type:report.evidence[0].is_key": _set(["report", "evidence", 0, "is_key"], "perhaps"),
    "missing:ground_truth.root_cause": _set(["ground_truth"], {"distractors": [{}]}),
    "type:ground_truth.distractors[0]": _set(["ground_truth"], {"root_cause": "r", "distractors": [1]}),
    "type:logs_manifest.files[0]": _set(["logs_manifest", "files", 0], []),
    "type:report.blast_radius.duration_minutes": _set(["report", "blast_radius"], {"duration_minutes": "long", "other": 1}),
}
GOOD = {
    "number as text": _set(["logs_manifest", "total_rows"], "12"),
    "whole float": _set(["usage", "llm_calls"], 2.0),
    "time as number": _set(["logs_manifest", "time_window", "start"], 1751351410),
    "flag as text": _set(["report", "evidence", 0, "is_key"], "yes"),
    "null id": _set(["report", "evidence", 0, "event_id"], None),
    "null truth": _set(["ground_truth"], None),
    "open truth": _set(["ground_truth"], {"root_cause": "r", "anything": [1]}),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, f(casedocs.good_case())) for k, f in (BAD | GOOD).items()]
    df = spark.createDataFrame(rows, "case_id string, text string")
    return {r.case_id: r.violations for r in validate_cases(parse_cases(df)).select("case_id", "violations").collect()}


def test_bad_documents_are_refused(judged):
    assert {k: judged[k] for k in BAD if k not in judged[k]} == {}


def test_good_documents_are_accepted(judged):
    assert {k: judged[k] for k in GOOD if judged[k]} == {}


def test_round_trip_keeps_every_case(spark, tmp_path):
    cases_dir, _ = casedocs.write(tmp_path)
    cases = validate_cases(read_cases(spark, [str(cases_dir)])).where("valid")
    write_cases(cases, str(tmp_path / "out"))
    again = validate_cases(read_cases(spark, str(tmp_path / "out"), layout="lines"))
    plain = lambda df: {r.case_id: (r.valid, r.c) for r in df.select("case_id", "valid", F.to_json("case").alias("c")).collect()}
    assert plain(again) == plain(cases) and len(plain(again)) == 4


def test_a_filter_on_valid_does_not_repeat_the_walk(spark):
    """The plan of the filtered table holds every step once, and running it takes no longer than without the filter."""
    rows = [(str(i), (GOOD["flag as text"] if i % 3 else BAD["type:case.model"])(casedocs.good_case())) for i in range(600)]
    judged = validate_cases(parse_cases(spark.createDataFrame(rows, "case_id string, text string")))
    seconds = []
    for df in (judged, judged, judged.where("valid")):  # the first run warms up
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 1.5 * seconds[1] + 1
    plan = judged.where("valid")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2 * len(judged._jdf.queryExecution().optimizedPlan().toString())
    assert judged.where("valid").count() == 400


def test_columns_of_the_same_names_and_null_documents(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", json.dumps(casedocs.good_case()), 3)], "case_id string, text string, level int")
    got = {r.case_id: (r.level, r.violations) for r in validate_cases(parse_cases(df)).collect()}
    assert got == {"a": (1, ["not_an_object"]), "b": (2, ["not_an_object"]), "c": (3, [])}
    assert validate_cases(parse_cases(df.limit(0))).collect() == []


def _changed(**at):
    def change(c):
        for path, value in at.items():
            *way, last = [int(k) if k.isdigit() else k for k in path.split("__")]
            node = c
            for k in way:
                node = node[k]
            node[last] = value
        return json.dumps(c)
    return change


#: Documents that need no walk, and what is wrong with them.
PLAIN = {
    "as it is": (_changed(), []),
    "no report": (_changed(report=None), []),
    "tools": (_changed(trajectory__1__tool="rm", trajectory__4__tool="ls"), ["enum:trajectory[1].tool=rm", "enum:trajectory[4].tool=ls"]),
    "values": (_changed(version="9", termination_reason="bored", report__confidence=1.5, trajectory__0__tool="rm"),
               ["enum:termination_reason=bored", "version", "range:report.confidence", "enum:trajectory[0].tool=rm"]),
    "odd arguments": (_changed(trajectory__2__args={"a.b `c": {"<x>": [{"y": [1, None]}]}}), []),
}
#: Faults that the type name of a whole list does not show.
HIDDEN = {
    "null in a later step": _changed(trajectory__3__stdout_excerpt=None),
    "no file in a later citation": lambda c: json.dumps(c["report"]["evidence"][1].pop("file") and c),
    "null among texts": _changed(report__unknowns=["a", None]),
    "null among lines": _changed(report__evidence__1__context_before=["a", None]),
    "four lines": _changed(report__evidence__1__context_after=list("abcd")),
    "time": _changed(report__evidence__1__ts="never"),
    "null step": _changed(trajectory__2=None),
}


def test_plain_documents_are_not_walked(spark, monkeypatch):
    from logcase.operators import caserules
    texts = [(k, f(casedocs.good_case())) for k, (f, _) in PLAIN.items()] + [(k, f(casedocs.good_case())) for k, f in (HIDDEN | BAD | GOOD).items()]
    cases = parse_cases(spark.createDataFrame(texts, "case_id string, text string"))
    plain = {r["case_id"]: r["p"] for r in cases.select("case_id", caserules._plain(F.col("doc")).alias("p")).collect()}
    assert {k for k, p in plain.items() if p} == set(PLAIN) | {"null id", "null truth"}
    found = {r["case_id"]: r["violations"] for r in validate_cases(cases).collect()}
    assert {k: found[k] for k in PLAIN} == {k: codes for k, (_, codes) in PLAIN.items()}
    assert all(found[k] for k in HIDDEN)
    monkeypatch.setattr(caserules, "_plain", lambda doc: F.lit(False))
    assert found == {r["case_id"]: r["violations"] for r in validate_cases(cases).collect()}

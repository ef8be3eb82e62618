"""Case-file and ground-truth documents for the tests (synthetic incident)."""
from __future__ import annotations

import copy
import json
from pathlib import Path

import incident

INCIDENT_ID = "archive-volume-2025-11-09"


def evidence(eid: str, line: int, key: bool = True, **extra) -> dict:
    e = {"event_id": eid, "file": "logs/archiver.log.jsonl", "line": line, "ts": "2025-11-09T01:12:30Z",
         "service": "archiver", "level": "error", "text_redacted": "write of segment 318 stopped, no space",
         "context_before": ["volume nearly full"], "context_after": [], "why": "the volume was full", "is_key": key}
    e.update(extra)
    return e


def good_case() -> dict:
    steps = [{"step": i + 1, "tool": t, "args": a, "stdout_excerpt": "ok", "elapsed_ms": 10 * (i + 1)}
             for i, (t, a) in enumerate([("schema", {}), ("top_errors", {"limit": 5}),
                                         ("search", {"pattern": "318"}), ("around", {"ts": "2025-11-09T01:12:30Z"}),
                                         ("trace", {"trace_id": "run-31"}), ("submit_incident_report", {})])]
    return {
        "version": "0.1", "question": "why are the reports old since 01:17?",
        "model": {"provider": "mock", "name": "scripted"},
        "logs_manifest": {"files": [{"path": "logs/archiver.log.jsonl", "bytes": 960, "rows": 8,
                                     "sha256": "ab" * 32}],
                          "time_window": {"start": "2025-11-09T01:00:00Z", "end": "2025-11-09T01:25:00Z"},
                          "total_rows": 33},
        "trajectory": steps,
        "report": {"root_cause": "the archive volume ran full", "blast_radius": "reports for 15 minutes",
                   "evidence": [evidence(e, i + 1) for i, e in enumerate(incident.ROOT_CAUSE_IDS[:2])]
                   + [evidence(None, 9, key=False)],
                   "remediation": "free the lock and rotate", "confidence": 0.7, "confidence_rationale": "the times follow each other"},
        "termination_reason": "submitted",
        "usage": {"llm_calls": 3, "tool_calls": 11, "wall_clock_s": 12.25},
    }


def distractor_case() -> dict:
    c = good_case()
    c["report"]["evidence"].append(evidence(incident.DISTRACTOR_IDS[0], 3))
    return c


def invalid_case() -> dict:
    c = good_case()
    c["surprise"] = 1
    c["report"]["confidence"] = 1.2
    c["report"]["evidence"][0]["context_before"] = ["a", "b", "c", "d"]
    c["trajectory"][1]["tool"] = "rm_rf"
    del c["model"]["name"]
    return c


def no_report_case() -> dict:
    c = good_case()
    c["report"] = None
    c["termination_reason"] = "max_iterations"
    return c


def object_blast_case() -> dict:
    c = copy.deepcopy(good_case())
    c["report"]["blast_radius"] = {"minutes": 15, "pages": 212, "since": "2025-11-09T01:17:05Z"}
    return c


def ground_truth() -> dict:
    return {"incident_id": INCIDENT_ID, "root_cause": "volume full since rotation stood still",
            "evidence_event_ids": incident.ROOT_CAUSE_IDS,
            "blast_radius": {"minutes": 15, "service": "reports"},
            "distractors": [{"event": d, "note": "seen on other nights too"} for d in incident.DISTRACTOR_IDS]}


CASES = {"good": good_case, "distractor": distractor_case, "invalid": invalid_case, "noreport": no_report_case,
         "objblast": object_blast_case}


def write(dir_: Path) -> tuple[Path, Path]:
    cases = dir_ / "cases"
    cases.mkdir(parents=True, exist_ok=True)
    for name, fn in CASES.items():
        (cases / f"{name}.case.json").write_text(json.dumps(fn(), indent=2))
    gt = dir_ / "ground_truth.json"
    gt.write_text(json.dumps(ground_truth(), indent=2))
    return cases, gt

"""A synthetic incident in the store's NDJSON line format.

Story (invented for these tests): on an archive host a lock file stops log rotation, the volume fills up at 01:12:30
and a segment is cut short; the index build that reads it gives up, and reports are rendered from an old index. Four
services with one file each, sparse extra keys, two bearer tokens, event ids for three causal and two unrelated lines.
"""
from __future__ import annotations

import hashlib
import json
from pathlib import Path

TOKEN = hashlib.sha256(b"bearer of the archive tests").hexdigest()[:36].upper()
ROOT_CAUSE_IDS = ["arch-volume-full", "index-gave-up", "report-old-index"]
DISTRACTOR_IDS = ["index-long-merge", "sched-clock-step"]


def _row(service: str, m: int, s: int, level: str, msg: str, **extra) -> dict:
    return {"ts": f"2025-11-09T01:{m:02d}:{s:02d}Z", "service": service, "level": level, "msg": msg, **extra}


def lines_by_service() -> dict[str, list[dict]]:
    archiver = [
        _row("archiver", 0, 0, "info", "rotation skipped, lock held", pid=4711),
        _row("archiver", 5, 0, "info", "volume filling", used=91),
        _row("archiver", 10, 0, "warn", "volume nearly full", used=97),
        _row("archiver", 12, 30, "error", "write of segment 318 stopped, no space", event_id="arch-volume-full", used=100),
        *[_row("archiver", 13 + k, 0, "error", "segment deferred", waiting=k + 1) for k in range(4)],
    ]
    indexer = [
        *[_row("indexer", 1 + k, 15, "info", "segment merged", trace_id=f"run-{20 + k}", request_id=f"job-{20 + k}") for k in range(3)],
        _row("indexer", 9, 50, "warn", "merge took 44 s", event_id="index-long-merge"),
        _row("indexer", 14, 40, "error", "segment 318 unreadable", event_id="index-gave-up", trace_id="run-31", request_id="job-31",
             upload_header="Bearer " + TOKEN),
        *[_row("indexer", 15 + k, 0, "error", "segment 318 unreadable", trace_id=f"run-{32 + k}") for k in range(4)],
    ]
    reports = [
        *[_row("reports", 2 + k, 30, "info", "rendered", pages=3 + k) for k in range(4)],
        _row("reports", 14, 41, "info", "asked for index", trace_id="run-31", stale_part=0.0),
        _row("reports", 17, 5, "warn", "index older than 15 minutes", event_id="report-old-index", request_id="job-31",
             authorization="Bearer " + TOKEN),
        *[_row("reports", 18 + k, 5, "warn", "index older than 15 minutes") for k in range(2)],
        _row("reports", 25, 0, "info", "25% of pages are old", stale_part=0.25),
    ]
    scheduler = [
        *[_row("scheduler", 4 * k, 1, "info", "tick", n=k) for k in range(6)],
        _row("scheduler", 16, 20, "info", "clock stepped by 2 s", event_id="sched-clock-step"),
    ]
    return {"archiver": archiver, "indexer": indexer, "reports": reports, "scheduler": scheduler}


def write(dir_: Path) -> list[Path]:
    dir_.mkdir(parents=True, exist_ok=True)
    out = []
    for svc, rows in lines_by_service().items():
        p = dir_ / f"{svc}.log.jsonl"
        p.write_text("".join(json.dumps(r) + "\n" for r in rows))
        out.append(p)
    return out


def all_rows() -> list[dict]:
    return [r for rows in lines_by_service().values() for r in rows]

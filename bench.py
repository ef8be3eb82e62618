"""Benchmark: ingest and incident queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf", "rows": {...}}.

Setup (not timed): one warm-up ingest on the sf0.001 tables; the log view of
``events`` is written as gzip NDJSON files in all export shapes. Timed: ingest of those files into the Parquet store,
parse + redaction of in-memory lines, redaction of whole documents, and the
queries over the written store.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logcase import get_session, scratch_dir  # noqa: E402
from logcase.operators import queries as Q  # noqa: E402
from logcase.operators.parse import parse_lines  # noqa: E402
from logcase.plans import checks  # noqa: E402
from logcase.plans import linebuild as LB  # noqa: E402
from logcase.plans.logfiles import write_log_files  # noqa: E402
from logcase.plans.logview import load_log_view  # noqa: E402
from logcase.plans.sizing import spread  # noqa: E402
from logcase.sources.ingest import ingest  # noqa: E402
from logcase.sources.store import read_events, write_events  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app_name="logcase-bench", shuffle_partitions=max(cpus, 8),
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # Warm-up (not timed): the same pipeline once on the smallest tables, so
    # the timings below measure steady-state work rather than JVM/JIT start-up.
    warm_dir = os.environ.get("BENCH_WARMUP_SF_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        wv = load_log_view(spark, warm_dir)
        wlogs = write_log_files(wv, LB.mixed_line(checks.bearer_msg()), "bench-warmup")
        wev, _ = ingest(spark, [wlogs], fallback_ts=checks.FALLBACK_TS)
        write_events(wev, scratch_dir(spark, "bench-warmup-store"), mode="overwrite")

    view = load_log_view(spark, sf_dir)
    logs = write_log_files(view, LB.mixed_line(checks.bearer_msg()), "bench-logs")
    store = scratch_dir(spark, "bench-store")

    def do_ingest():
        events, _ = ingest(spark, [logs], fallback_ts=checks.FALLBACK_TS)
        write_events(events, store, mode="overwrite")
    timed("ingest_to_store", do_ingest)
    ev = read_events(spark, store)
    rows["events"] = ev.count()

    lines = spread(view.select("event_id", LB.mixed_line(checks.bearer_msg()).alias("value")))
    timed("parse_redact_lines", lambda: run(parse_lines(lines, fallback_ts=checks.FALLBACK_TS)))
    timed("redact_documents", lambda: run(checks.q_redact_documents(spark, sf_dir)))
    timed("schema", lambda: Q.describe(ev).collect())
    timed("top_errors", lambda: Q.top_errors(ev, 20).collect())
    timed("search", lambda: Q.search(ev, "r_or k", 10).collect())
    timed("around", lambda: Q.around(ev, checks.AROUND_AT, checks.AROUND_WINDOW_S).collect())
    timed("trace", lambda: Q.trace(ev, checks.TRACE_ID).collect())
    for name in getattr(checks, "BENCH_EXTRA", ()):
        timed(name, lambda n=name: run(checks.QUERIES[n](spark, sf_dir)))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "rows": rows}))


if __name__ == "__main__":
    main()

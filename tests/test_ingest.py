"""Ingest from files: golden incident, scan edges, documents, line numbers."""
import gzip
import json

import pytest
from pyspark.sql import functions as F

import incident
from logcase.sources.ingest import IngestCapExceeded, ingest, manifest, require_rows

FB = "2000-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def incident_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("incident")
    incident.write(d / "logs")
    return d / "logs"


@pytest.fixture(scope="module")
def store(spark, incident_dir):
    ev, listing = ingest(spark, [str(incident_dir)], fallback_ts=FB)
    return ev.cache(), listing


def test_golden_counts(spark, store):
    ev, listing = store
    rows = incident.all_rows()
    assert ev.count() == len(rows)
    files, totals = manifest(ev, listing)
    t = totals.first()
    assert (t.total_rows, t.n_files) == (len(rows), 4)
    stamps = sorted(r["ts"] for r in rows)
    assert t.start.isoformat() + "Z" == stamps[0] and t.end.isoformat() + "Z" == stamps[-1]
    by_level = {r.level: r["count"] for r in ev.groupBy("level").count().collect()}
    want = {}
    for r in rows:
        want[r["level"]] = want.get(r["level"], 0) + 1
    assert by_level == want
    assert ev.where(F.col("format") != "generic").count() == 0
    require_rows(totals)


def test_lines_follow_files(spark, store):
    ev, _ = store
    for svc, rows in incident.lines_by_service().items():
        got = [r.msg for r in ev.where(F.col("file").endswith(f"/{svc}.log.jsonl")).orderBy("line").collect()]
        assert got == [r["msg"] for r in rows]


def test_bearer_tokens_redacted(spark, store):
    ev, _ = store
    assert ev.where(F.col("raw").contains(incident.TOKEN[:12])).count() == 0
    assert ev.where(F.col("raw").contains("[REDACTED_BEARER]")).count() == 2


def test_trace_ids_materialised(spark, store):
    ev, _ = store
    assert ev.where(F.col("trace_id") == "run-31").count() == 2
    assert ev.where(F.col("request_id") == "job-31").count() == 2


def test_scan_edges(spark, tmp_path):
    d = tmp_path / "edges"
    (d / "sub").mkdir(parents=True)
    (d / "crlf.log").write_bytes(b"one\r\ntwo\r\n\r\nfour")          # CRLF, blank, no final newline
    with gzip.open(d / "z.gz", "wt") as f:
        f.write('{"msg":"gz1"}\n\n{"msg":"gz2"}\n')
    (d / "empty.log").write_text("")
    (d / "sub" / "skip.json").write_text('{"msg":"explicit"}\n')
    (d / "notes.txt").write_text("ignored\n")
    ev, listing = ingest(spark, [str(d), str(d / "sub" / "skip.json")], fallback_ts=FB)
    got = {(r.file.rsplit("/", 1)[1], r.line, r.msg) for r in ev.collect()}
    assert got == {("crlf.log", 1, "one"), ("crlf.log", 2, "two"), ("crlf.log", 4, "four"),
                   ("z.gz", 1, "gz1"), ("z.gz", 3, "gz2"), ("skip.json", 1, "explicit")}
    files, _ = manifest(ev, listing)
    rows = {r.path.rsplit("/", 1)[1]: r.rows for r in files.collect()}
    assert rows == {"crlf.log": 3, "z.gz": 2, "empty.log": 0, "skip.json": 1}


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest(spark, [str(tmp_path / "nope.log")])


def test_documents(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    ev1 = {"ts": "2025-07-01T06:30:10Z", "service": "kiln", "level": "debug", "msg": "one"}
    ev2 = {"service": "lathe", "ts": "2025-07-01T06:31:40Z", "msg": "two", "shift": 3}
    (d / "array.log").write_text(json.dumps([ev1, ev2]))
    (d / "data.log").write_text(json.dumps({"data": [ev1, ev2], "meta": {"page": 1}}, indent=2))
    (d / "nrql.log").write_text(json.dumps({"results": [{"events": [ev1]}, {"events": [ev2]}]}))
    (d / "flat.log").write_text(json.dumps({"results": [ev1, ev2]}))
    (d / "events.log").write_text(json.dumps({"events": [ev1, ev2]}, indent=1))
    (d / "pretty.log").write_text(json.dumps(ev1, indent=2))
    (d / "numbers.log").write_text(json.dumps({"ts": "2025-07-01T06:30:10Z", "data": [1, 2]}))
    (d / "strings.log").write_text(json.dumps(["plain text line", ev1]))
    (d / "ndjson.log").write_text(json.dumps(ev1) + "\n" + json.dumps(ev2) + "\n")
    (d / "twoline.log").write_text("[\n" + json.dumps(ev1) + "]\n")
    ev, _ = ingest(spark, [str(d)], fallback_ts=FB)
    got = {}
    for r in ev.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.msg))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["array.log"] == [(1, "one"), (2, "two")]
    assert got["data.log"] == [(1, "one"), (2, "two")]
    assert got["nrql.log"] == [(1, "one")]                       # results[1:] are lost
    assert got["flat.log"] == [(1, "one"), (2, "two")]
    assert got["events.log"] == [(1, "one"), (2, "two")]
    assert len(got["pretty.log"]) == 6                           # one plaintext row per line
    assert got["numbers.log"] == [(1, "1"), (2, "2")]
    assert got["strings.log"] == [(1, "plain text line"), (2, "one")]
    assert got["ndjson.log"] == [(1, "one"), (2, "two")]
    assert got["twoline.log"] == [(1, "one")]


def test_line_numbers_across_many_splits(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    n = 20000
    (d / "plain.log").write_text("".join(("" if i % 97 == 0 else f"row {i}") + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        ev, _ = ingest(spark, [str(d)], fallback_ts=FB)
        bad = ev.where(F.col("msg") != F.concat(F.lit("row "), F.col("line").cast("string"))).count()
        total = ev.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert bad == 0
    assert total == n - n // 97


def test_rebalance_same_rows(spark, store, incident_dir):
    ev, _ = store
    again, _ = ingest(spark, [str(incident_dir)], fallback_ts=FB, rebalance=True)
    cols = ["file", "line", "ts", "service", "level", "msg", "raw"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, ev.select(*cols).collect()))


def test_caps(spark, incident_dir):
    with pytest.raises(IngestCapExceeded):
        ingest(spark, [str(incident_dir)], max_bytes=100)
    with pytest.raises(IngestCapExceeded):
        ingest(spark, [str(incident_dir)], max_rows=10)


def test_caps_fall_at_a_file_in_path_order(spark, tmp_path):
    d = tmp_path / "capped"
    for name, lines in (("a/z.log", 3), ("a-b/c.log", 2), ("a/empty.log", 0), ("b.log", 4)):
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_text("x\n\n" * lines)                       # every second line is blank: bytes, but no row
    (d / "c.log").write_text(json.dumps([{"msg": "1"}, {"msg": "2"}, "  "]))  # a document of two rows and a blank item
    size = (d / "c.log").stat().st_size
    order = [("a/z.log", 9, 3), ("a-b/c.log", 15, 5), ("b.log", 27, 9), ("c.log", 27 + size, 11)]
    for k, what in enumerate(("max_bytes", "max_rows"), 1):
        for cap in (order[0][k] - 1, order[1][k], order[3][k] - 1):
            first = next(o for o in order if o[k] > cap)
            with pytest.raises(IngestCapExceeded, match="cap exceeded at") as e:
                ingest(spark, [str(d)], **{what: cap})
            assert e.value.path.endswith(first[0]) and (e.value.total, e.value.cap) == (first[k], cap)
    # totals equal to the caps are allowed
    assert ingest(spark, [str(d)], fallback_ts=FB, max_bytes=order[3][1], max_rows=order[3][2])[0].count() == 11


def test_byte_cap_is_decided_before_reading(spark, tmp_path, monkeypatch):
    from logcase.sources import ingest as I
    (tmp_path / "a.log").write_text("one\n")
    monkeypatch.setattr(I, "raw_scan", lambda *_: pytest.fail("files were read"))
    with pytest.raises(IngestCapExceeded):
        ingest(spark, [str(tmp_path)], max_bytes=3)


def test_running_totals(spark):
    from logcase.sources.caps import running_total
    rows = [(f"p{k:04d}", k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows[::-1], "path string, n bigint").repartition(7)
    got = {r.path: r.total for r in running_total(df, F.col("path"), "n", "total").collect()}
    at = 0
    for path, n in rows:
        at += n
        assert got[path] == at
    assert running_total(df.limit(0), F.col("path"), "n", "total").count() == 0


def test_content_digest_over_any_splits(spark, tmp_path):
    import hashlib

    from logcase.sources.digest import content_digests
    lines = [f"row {i} é" if i % 9 else "" for i in range(1, 4001)]

    def whole(lines):
        words = [0] * 8
        for i, x in enumerate(lines, 1):
            h = hashlib.sha256(f"{i}:{x}".encode()).digest()
            words = [(w + int.from_bytes(h[4 * k:4 * k + 4])) % 2**32 for k, w in enumerate(words)]
        return len(lines), hashlib.sha256(f"{len(lines)}:{','.join(map(str, words))}".encode()).hexdigest()

    text = "\n".join(lines)
    (tmp_path / "plain.log").write_text(text + "\n")
    (tmp_path / "crlf.log").write_bytes(text.replace("\n", "\r\n").encode())
    with gzip.open(tmp_path / "packed.gz", "wt") as f:
        f.write(text)
    (tmp_path / "swapped.log").write_text("\n".join([*lines[:10], lines[11], lines[10], *lines[12:]]))
    (tmp_path / "empty.log").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    for cut in (old, "4096", "1777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            got = {r.path.rsplit("/", 1)[1]: (r.n_lines, r.content_digest) for r in content_digests(spark, [str(tmp_path)]).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got["plain.log"] == got["crlf.log"] == got["packed.gz"] == whole(lines)
        assert got["empty.log"] == whole([]) and got["swapped.log"][1] != got["plain.log"][1]
        seen.add(tuple(sorted(got.items())))
    assert len(seen) == 1
    ev, listing = ingest(spark, [str(tmp_path)], fallback_ts=FB)
    files, _ = manifest(ev, listing, with_digest=True)
    assert {r.path.rsplit("/", 1)[1]: (r.n_lines, r.content_digest) for r in files.collect()} == got


def test_changed_split_layout_fails_loudly(spark, tmp_path):
    d = tmp_path / "layout"
    d.mkdir()
    (d / "plain.log").write_text("".join(f"row {i}\n" for i in range(1, 5001)))
    ev, _ = ingest(spark, [str(d)], fallback_ts=FB)          # statistics: one split
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")   # line scan: many splits
    try:
        with pytest.raises(Exception, match="input splits changed"):
            ev.select("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_document_after_blank_lines(spark, tmp_path):
    d = tmp_path / "blankdoc"
    d.mkdir()
    ev1 = {"service": "kiln", "ts": "2025-07-01T06:30:10Z", "msg": "one"}
    (d / "lead.log").write_text("\n  \n" + json.dumps([ev1, ev1]) + "\n\n")
    (d / "tail.log").write_text(json.dumps(ev1) + "\n" + "[\n")          # complete first line, then junk
    ev, _ = ingest(spark, [str(d)], fallback_ts=FB)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.msg) for r in ev.collect())
    assert got == [("lead.log", 1, "one"), ("lead.log", 2, "one"), ("tail.log", 1, "one"), ("tail.log", 2, "[")]


def test_manifest_sha256_and_range_layout(spark, store, incident_dir, tmp_path):
    import hashlib

    from logcase.sources.store import read_events, write_events
    ev, listing = store
    files, _ = manifest(ev, listing, with_sha256=True, spark=spark)
    for r in files.collect():
        with open(r.path, "rb") as f:
            assert r.sha256 == hashlib.sha256(f.read()).hexdigest()
    write_events(ev, str(tmp_path / "ranged"), mode="overwrite", layout="range", partitions=3)
    back = read_events(spark, str(tmp_path / "ranged"))
    cols = ["file", "line", "ts", "service", "level", "msg"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, ev.select(*cols).collect()))
    assert "event_date" in back.columns


def test_no_rows_raises(spark, tmp_path):
    from logcase.sources.ingest import require_rows
    d = tmp_path / "blank"
    d.mkdir()
    (d / "only-blank.log").write_text("\n \n\t\n")
    ev, listing = ingest(spark, [str(d)], fallback_ts=FB)
    files, totals = manifest(ev, listing)
    assert [r.rows for r in files.collect()] == [0]
    with pytest.raises(ValueError, match="no rows"):
        require_rows(totals)

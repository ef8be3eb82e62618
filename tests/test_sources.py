"""Odd file names, repeated paths, documents, streams that start anew, scratch folders."""
import gzip
import itertools
import json
import os
import random

import incident
import pytest
from pyspark.sql import functions as F

from logcase import session
from logcase.operators.parse import parse_lines
from logcase.schema import EVENTS_SCHEMA
from logcase.sources import documents
from logcase.sources.documents import document_items
from logcase.sources.ingest import ingest, manifest
from logcase.sources.store import read_events
from logcase.streaming import ingest_stream, read_events_stream

FB = "2000-01-01T00:00:00Z"
NAMES = ["my app.log", "a+b%20c.log", "x[1]{2}.log", "q?*.log", "ünï#.log"]


def test_names_and_repeats(spark, tmp_path):
    d = tmp_path / "odd names"
    (d / "sub").mkdir(parents=True)
    for k, n in enumerate(NAMES):
        (d / n).write_text("line\n" * (k + 1))
    (d / "doc one.log").write_text(json.dumps([{"msg": "a"}, {"msg": "b"}]))
    (d / "empty one.log").write_text("")
    (d / "sub" / "extra.txt").write_text("explicit\n")
    paths = [str(d), str(d / NAMES[0]), str(d / "sub"), str(d / "doc one.log"), str(d / "sub" / "extra.txt"), str(d / "sub" / "extra.txt")]
    ev, listing = ingest(spark, paths, fallback_ts=FB)
    files, totals = manifest(ev, listing, with_sha256=True, spark=spark)
    got = {os.path.basename(r.path): (r.bytes, r.rows) for r in files.collect()}
    want = {n: (5 * (k + 1), k + 1) for k, n in enumerate(NAMES)} | {"doc one.log": (28, 2), "empty one.log": (0, 0), "extra.txt": (9, 1)}
    assert got == want and files.count() == len(want)
    assert totals.first().total_rows == ev.count() == 18
    assert {r.line for r in ev.where(F.col("file").endswith(NAMES[4])).collect()} == {1, 2, 3, 4, 5}


def test_bracketed_text_is_no_document(spark, tmp_path):
    texts = {"time.log": "[2026-01-05 08:00:00] up\n[2026-01-05 08:00:01] down]\n", "tag.log": "[main] x\n[INFO] y\n", "open.log": "[\n1, 2\nend\n",
             "half.log": '[{"msg": "a"},\n', "two.log": "[1]\n[2]\n"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    with gzip.open(tmp_path / "doc.gz", "wt") as f:
        f.write('{"events":\n [{"msg": "z"}, "plain"]}\n')
    (tmp_path / "none.log").write_text("[\n]\n")
    ev, _ = ingest(spark, [str(tmp_path)], fallback_ts=FB)
    got = {}
    for r in ev.orderBy("line").collect():
        got.setdefault(os.path.basename(r.file), []).append(r.msg)
    assert got == {n: t.strip("\n").split("\n") for n, t in texts.items()} | {"doc.gz": ["z", "plain"]}


def test_document_items():
    assert document_items(' [1, "a\\n", {"b": [2]}] ') == ["1", "a\n", '{"b": [2]}']
    assert document_items('{"data": 1, "data": [2], "events": [3]}') == ["2"]
    assert document_items('{"results": [{"events": [4, 5]}, {"events": [6]}]}') == ["4", "5"]
    assert document_items('{"results": [{"x": 1}], "events": [7]}') == ['{"x": 1}']
    assert document_items('{"results": [8], "events": [7]}') == ["7"] and document_items("[]") == []
    for bad in ("", "[1,]", "[1] 2", "{}", '{"data": 1}', '{"a" 1}', "[1 2]", "{1: []}", "[", "7"):
        assert document_items(bad) is None


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_documents_in_pieces(monkeypatch, size):
    """Wherever the text is cut, the items are those of a decoder that sees it whole."""
    monkeypatch.setattr(documents, "_GROW", 1)
    rng = random.Random(size)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [rng.randrange(-99, 99), rng.choice(["", "a,b", "\n\"", "é]", "\ud800"]), rng.choice([True, None, 1.5e-7]), "x" * 40][kind]
        if kind < 6:
            return {rng.choice(["events", "data", "k"]): value(depth - 1) for _ in range(rng.randrange(3))}
        return [value(depth - 1) for _ in range(rng.randrange(4))]

    for _ in range(150):
        whole = {k: rng.choice([value(3), [value(2) for _ in range(rng.randrange(4))]]) for k in rng.sample(["data", "results", "events", "other"], rng.randrange(5))}
        whole = whole if rng.random() < 0.8 else [value(2) for _ in range(rng.randrange(5))]
        lists = {k: v for k, v in whole.items() if isinstance(v, list)} if isinstance(whole, dict) else {}
        results = lists.get("results") or [None]
        inner = results[0].get("events") if isinstance(results[0], dict) else None
        want = whole if isinstance(whole, list) else lists["data"] if "data" in lists else inner if isinstance(inner, list) \
            else results if isinstance(results[0], dict) else lists.get("events")
        text = json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        got = document_items(text[k:k + size] for k in range(0, len(text), size))
        assert (got is None) == (want is None)
        assert want is None or [x if isinstance(w, str) else json.loads(x) for x, w in zip(got, want, strict=True)] == want
        for bad in (text[:-1], text + ",", text + " 1", text.replace(":", "=", 1) if isinstance(whole, dict) and whole else "[1 2]"):
            assert document_items(bad[k:k + size] for k in range(0, len(bad), size)) is None


def test_too_large_values_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MOST_ITEM_CHARS", 1000)
    monkeypatch.setattr(documents, "_GROW", 64)
    with pytest.raises(documents.DocumentItemTooLarge, match="character 9 "):
        document_items(c for c in '[1, 2,   "' + "x" * 5000 + '"]')
    # what can no longer be JSON is given up at once, however long it goes on
    assert document_items(itertools.chain(["[1, oops, "], itertools.repeat(" " * 50, 10 ** 5))) is None


def test_a_line_beyond_variant_is_refused_by_name(spark):
    line = F.concat(F.lit('{"msg":"'), F.repeat(F.lit("x"), (F.col("id") + 140_000_000).cast("int")), F.lit('"}'))
    df = spark.range(1).select(line.alias("value"), F.lit("big.log").alias("file"), F.lit(7).alias("line"))
    with pytest.raises(Exception, match="big.log line 7"):
        parse_lines(df).agg(F.max(F.length("msg"))).collect()


def test_documents_of_many_splits(spark, tmp_path):
    """Documents cut into many splits, compressed, with odd separators; and texts that are none."""
    items = [{"message": f"m{k}, \u00e9" + "y" * (k % 90), "service": "s"} for k in range(3000)]
    (tmp_path / "split.log").write_text(json.dumps({"meta": {"a": [1, 2]}, "events": items}, indent=2, ensure_ascii=False))
    (tmp_path / "packed.log.gz").write_bytes(gzip.compress(json.dumps({"results": [{"x": 1, "events": items}, {"events": [5]}]}, indent=1).encode()))
    (tmp_path / "empty.log").write_text('{\n"data": []\n}')
    (tmp_path / "none.log").write_text('{\n"data": [1,]\n}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = documents.read_documents(spark, [str(p) for p in sorted(tmp_path.iterdir())]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"].split("/")[-1], []).append((r["line"], r["value"]))
    assert sorted(by_file) == ["empty.log", "packed.log.gz", "split.log"] and by_file["empty.log"] == [(0, None)]
    for name in ("split.log", "packed.log.gz"):
        rows = sorted(by_file[name])
        assert [k for k, _ in rows] == list(range(3001)) and [json.loads(v) for _, v in rows[1:]] == items


def test_large_document(spark, tmp_path):
    """More than a VARIANT can hold: every event comes out."""
    n, pad = 37_500, "p" * 4000
    with (tmp_path / "large.log").open("w") as f:
        f.write('{"meta": {"pages": 3}, "data": [')
        f.writelines((", " if k else "") + json.dumps({"msg": f"m{k}", "pad": pad}) for k in range(n))
        f.write("]}")
    assert (tmp_path / "large.log").stat().st_size > 140 << 20
    ev, _ = ingest(spark, [str(tmp_path)], fallback_ts=FB)
    r = ev.agg(F.count("*").alias("n"), F.count_distinct("msg").alias("k"), F.max("line").alias("last")).first()
    assert (r.n, r.k, r["last"]) == (n, n, n)


def test_raw_lines_are_not_shuffled(spark, tmp_path, monkeypatch):
    """The split table decides which lines count; with a table that may be broadcast no line moves."""
    (tmp_path / "a.log").write_text("x\ny\n")
    (tmp_path / "d.log").write_text('[{"msg": "z"}]')
    from logcase.sources.ingest import read_event_lines
    lines, _ = read_event_lines(spark, [str(tmp_path)])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_new_checkpoint_keeps_old_data(spark, tmp_path):
    incident.write(tmp_path / "one")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.log").write_text('{"ts":"2025-11-10T01:00:00Z","service":"other","level":"warn","msg":"later"}\n')
    sink = str(tmp_path / "sink")
    before = set(os.listdir(session.ensure_checkpoint_dir(spark).removeprefix("file:")))
    for name in ("one", "two"):
        ingest_stream(spark, str(tmp_path / name), sink, str(tmp_path / f"ckpt-{name}"), fallback_ts=FB).awaitTermination()
    after = set(os.listdir(session.ensure_checkpoint_dir(spark).removeprefix("file:")))
    assert after - before == set()  # each batch removes its scratch folders
    stored = read_events(spark, sink)
    assert stored.count() == len(incident.all_rows()) + 1 and stored.where("service = 'other'").count() == 1

    fields = list(EVENTS_SCHEMA.fieldNames())
    stream = read_events_stream(spark, sink)
    assert read_events_stream(spark, sink).columns == stream.columns == [*fields, "event_date"] and EVENTS_SCHEMA.fieldNames() == fields
    q = stream.groupBy("event_date").count().writeStream.outputMode("complete").format("memory").queryName("days").option(
        "checkpointLocation", str(tmp_path / "ckpt-days")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r.event_date): r["count"] for r in spark.table("days").collect()} == {"2025-11-09": len(incident.all_rows()), "2025-11-10": 1}


def test_late_rows_are_dropped(spark, tmp_path):
    from logcase.streaming import error_counts_stream
    at = lambda h, m: {"ts": f"2025-11-09T{h:02d}:{m:02d}:00Z", "service": "s", "level": "error", "msg": "e"}
    (tmp_path / "in").mkdir()
    batches = [[at(1, 0), at(1, 30), at(3, 0)], [at(1, 1), at(3, 1)], [at(6, 0)]]  # 01:01 comes after the watermark of 02:50
    run = lambda: ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "ckpt"), fallback_ts=FB).awaitTermination()
    for k, rows in enumerate(batches):
        (tmp_path / "in" / f"{k}.log").write_text("".join(json.dumps(r) + "\n" for r in rows))
        run()
        counts = error_counts_stream(read_events_stream(spark, str(tmp_path / "sink")), "1 hour", "10 minutes")
        counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "counts")).option(
            "checkpointLocation", str(tmp_path / "ckpt-counts")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.window_start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert got == {(1, 2), (3, 2)}


class _Cluster:
    class sparkContext:  # noqa: N801
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)


def test_no_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.ensure_checkpoint_dir(_Cluster())
    for master, local in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False)):
        _Cluster.sparkContext.master = master
        assert session.runs_in_one_process(_Cluster()) is local

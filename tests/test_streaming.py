"""Streaming ingest equals batch ingest; windowed error counts."""
from pyspark.sql import functions as F

import incident
from logcase.sources.ingest import ingest
from logcase.sources.store import read_events
from logcase.streaming import error_counts_stream, ingest_stream, read_events_stream

FB = "2000-01-01T00:00:00Z"
COLS = ["file", "line", "ts", "service", "level", "msg", "raw"]


def test_stream_equals_batch_and_counts(spark, tmp_path):
    incident.write(tmp_path / "logs")
    q = ingest_stream(spark, str(tmp_path / "logs"), str(tmp_path / "sink"), str(tmp_path / "ckpt"), fallback_ts=FB)
    q.awaitTermination()
    streamed = read_events(spark, str(tmp_path / "sink")).select(*COLS)
    batch, _ = ingest(spark, [str(tmp_path / "logs")], fallback_ts=FB)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.select(*COLS).collect()))

    counts = error_counts_stream(read_events_stream(spark, str(tmp_path / "sink")), "1 minute", "1 minute")
    w = (counts.writeStream.outputMode("append").format("memory").queryName("err_counts")
         .option("checkpointLocation", str(tmp_path / "ckpt2")).trigger(availableNow=True).start())
    w.awaitTermination()
    got = {(r.window_start, r.service, r.msg): r.n for r in spark.table("err_counts").collect()}
    last = batch.where(F.col("level").isin("error", "warn")).agg(F.max("ts")).first()[0]
    want = (batch.where(F.col("level").isin("error", "warn"))
            .groupBy(F.window("ts", "1 minute").alias("w"), "service", "msg").count()
            .where(F.col("w.end") <= F.lit(last) - F.expr("INTERVAL 1 MINUTE")).collect())
    assert got == {(r.w.start, r.service, r.msg): r["count"] for r in want} and got


def test_stream_is_incremental(spark, tmp_path):
    logs = tmp_path / "logs"
    incident.write(logs)
    args = (str(logs), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    ingest_stream(spark, *args, fallback_ts=FB).awaitTermination()
    first = read_events(spark, str(tmp_path / "sink")).count()
    (logs / "late.log").write_text('{"ts":"2025-11-09T01:50:00Z","service":"late","level":"error","msg":"x"}\n')
    ingest_stream(spark, *args, fallback_ts=FB).awaitTermination()
    after = read_events(spark, str(tmp_path / "sink"))
    assert first == len(incident.all_rows())
    assert after.count() == first + 1 and after.where(F.col("service") == "late").count() == 1

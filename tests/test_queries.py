"""The five queries on the synthetic incident, and their edge rules."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

import incident
from logcase.operators import queries as Q
from logcase.sources.ingest import ingest
from logcase.sources.store import read_events, write_events


STORE: list[str] = []


@pytest.fixture(scope="module")
def ev(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("q")
    incident.write(d / "logs")
    events, _ = ingest(spark, [str(d / "logs")], fallback_ts="2000-01-01T00:00:00Z")
    write_events(events, str(d / "store"), mode="overwrite")
    STORE.append(str(d / "store"))
    return read_events(spark, str(d / "store")).cache()


def test_describe(ev):
    r = Q.describe(ev).first()
    assert r.services == sorted({x["service"] for x in incident.all_rows()})
    assert r.levels == ["error", "info", "warn"] and r.n_rows == len(incident.all_rows())


def test_top_errors(ev):
    rows = Q.top_errors(ev, limit=3).collect()
    assert rows[0].n >= rows[1].n >= rows[2].n
    assert {r.msg for r in rows} >= {"segment 318 unreadable"}
    assert all(r.level in ("error", "warn") for r in Q.top_errors(ev, 50).collect())


def test_search_like_rules(spark, ev):
    hits = Q.search(ev, "SEGMENT 3_8 unread", limit=50).collect()
    assert len(hits) == 5 and [h.ts for h in hits] == sorted(h.ts for h in hits)
    assert len(Q.search(ev, "segment%readable", limit=50).collect()) == 5
    assert Q.search(ev, "318", limit=2).count() == 2
    assert Q.search(ev, "segment\\_318", limit=50).count() == 0      # '\' is an ordinary character
    assert Q.search(ev, "stale_part", limit=50).count() == 2               # found in raw only
    assert Q.search(ev, "25% of", limit=50, mode="literal").count() == 1


def test_around_inclusive_edges(ev):
    at = "2025-11-09T01:14:00Z"
    rows = Q.around(ev, at, window_s=60).collect()
    ts = [r.ts for r in rows]
    assert (min(ts), max(ts)) == (dt.datetime(2025, 11, 9, 1, 13), dt.datetime(2025, 11, 9, 1, 15))  # both ends count
    only = Q.around(ev, dt.datetime(2025, 11, 9, 1, 14, tzinfo=dt.timezone.utc), 60, service="indexer")
    assert {r.service for r in only.collect()} == {"indexer"}
    assert Q.around(ev, at, 60, service="").count() == len(rows)
    with pytest.raises(ValueError):
        Q.around(ev, "not a time")


def test_around_prunes_partitions(spark, ev):
    fresh = spark.read.option("mergeSchema", "false").parquet(STORE[0])   # not matched to the cached copy
    plan = Q.around(fresh, "2025-11-09T01:14:40Z", 60)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_trace(ev):
    rows = Q.trace(ev, "run-31").collect()
    assert [r.service for r in rows] == ["indexer", "reports"]
    assert Q.trace(ev, "job-31").count() == 2 and Q.trace(ev, "nope").count() == 0


def test_set_forms(spark, ev):
    anchors = spark.createDataFrame([("a", dt.datetime(2025, 11, 9, 1, 14, 40))], "anchor_id string, anchor_ts timestamp")
    many = Q.around_many(ev, anchors, 40).select(*Q.ROW_COLUMNS if hasattr(Q, "ROW_COLUMNS") else
                                                 ["ts", "service", "level", "msg", "file", "line"])
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, Q.around(ev, "2025-11-09T01:14:40Z", 40).collect()))
    ids = spark.createDataFrame([("run-31",), ("job-31",)], "id string")
    got = Q.trace_many(ev, ids).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {"run-31": 2, "job-31": 2}


def test_msg_short(ev):
    df = Q.with_msg_short(ev.select("msg").limit(1).withColumn("msg", F.lit("x" * 70)), "top_errors")
    assert df.first().msg_short == "x" * 60 + "…"


def test_describe_empty(spark, ev):
    r = Q.describe(ev.limit(0)).first()
    assert (r.services, r.levels, r.ts_min, r.ts_max, r.n_rows) == ([], [], None, None, 0)
    assert Q.top_errors(ev.limit(0)).count() == 0


def test_trace_pushes_ids_to_parquet(spark, ev):
    fresh = spark.read.option("mergeSchema", "false").parquet(STORE[0])
    plan = Q.trace(fresh, "run-31")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters:"):].split("]")[0]
    print(pushed)
    assert "EqualTo(trace_id,run-31)" in pushed and "EqualTo(request_id,run-31)" in pushed


def test_around_counts_and_services(spark, ev):
    anchors = ev.where("level = 'error'").select(F.concat_ws("#", "file", "line").alias("anchor_id"), F.col("ts").alias("anchor_ts"),
                                                 F.when(F.col("line") % 2 == 0, F.col("service")).alias("only"))
    pairs = Q.around_many(ev, anchors, 45)
    want = {r.anchor_id: r["count"] for r in pairs.groupBy("anchor_id").count().collect()}
    assert {r.anchor_id: r.n for r in Q.around_counts(ev, anchors, 45).collect()} == want and max(want.values()) > 1
    some = Q.around_many(ev, anchors, 45, anchor_service="only").join(anchors.select("anchor_id", "only"), "anchor_id")
    assert some.where("only is not null and only <> service").count() == 0
    assert some.where("only is null").count() == pairs.join(anchors.where("only is null").select("anchor_id"), "anchor_id").count()


def test_trace_with_more_id_places(spark):
    rows = [("{\"attributes\":{\"trace_id\":\"t1\"}}", 1), ("{\"trace.trace_id\":\"t1\"}", 2), ("{\"trace_id\":\"t1\"}", 3), ("{\"trace_id\":\"t2\"}", 4)]
    df = spark.createDataFrame(rows, "raw string, line bigint").selectExpr(
        "timestamp'2025-01-01' as ts", "'s' as service", "'info' as level", "'m' as msg", "raw", "'f' as file", "line")
    assert [r.line for r in Q.trace(df, "t1").collect()] == [3]
    assert [r.line for r in Q.trace(df, "t1", ("$.attributes.trace_id", "$['trace.trace_id']")).collect()] == [1, 2, 3]

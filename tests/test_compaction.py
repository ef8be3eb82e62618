"""Compaction of the events store: same rows from fewer files, whatever runs beside it."""
import pytest
from pyspark.sql import functions as F

from logcase.operators import queries as Q
from logcase.schema import EVENTS_SCHEMA
from logcase.sources import compaction as C
from logcase.sources import search_index as S
from logcase.sources.store import read_events, write_events


def _events(spark, first, n):
    k = F.col("id")
    values = {"ts": F.timestamp_seconds(1_700_000_000 + k * 600), "service": F.concat(F.lit("s"), (k % 3).cast("string")), "level": F.lit("error"),
              "msg": F.concat(F.lit("disk "), k.cast("string")), "raw": F.md5(k.cast("string")), "file": F.lit("f"), "line": k, "trace_id": k.cast("string")}
    rows = spark.range(first, first + n).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS_SCHEMA])
    return rows.repartition(4)


def _rows(df):
    return sorted(tuple(r) for r in df.select("event_date", "ts", "service", "msg", "raw", "line", "trace_id").collect())


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path / "my store + [1]")
    for first in (0, 300, 300):  # the last write repeats rows
        write_events(_events(spark, first, 300), path)
    return path


def test_same_rows_from_fewer_files(spark, store):
    before, early = _rows(read_events(spark, store)), read_events(spark, store)
    n = len(early.inputFiles())
    days = len({r[0] for r in before})
    written = C.compact(spark, store)
    after = read_events(spark, store)
    assert _rows(after) == before and len(after.inputFiles()) == written == days < n
    assert _rows(early) == before  # a reader that began before keeps its files
    assert C.compact(spark, store) == 0 and C.version(spark, store) == 1
    write_events(_events(spark, 600, 200), store)  # appended files are listed, and packed with what is there
    more = _rows(read_events(spark, store))
    assert len(more) == len(before) + 200
    assert C.compact(spark, store) > 0 and C.version(spark, store) == 2
    assert _rows(read_events(spark, store)) == more
    assert C.remove_replaced(spark, store) >= n and C.remove_replaced(spark, store) == 0
    assert _rows(read_events(spark, store)) == more
    around = Q.around(read_events(spark, store), "2023-11-15T00:00:00Z", 3600)
    assert around.count() == Q.around(spark.createDataFrame(read_events(spark, store).collect(), after.schema), "2023-11-15T00:00:00Z", 3600).count() > 0


def test_sizes_within_bounds(spark, store):
    files = spark.createDataFrame([(f"/s/event_date=2024-01-0{d}/p{k}.parquet", b) for d in range(1, 4) for k, b in
                                   enumerate([10, 49, 49, 30, 5, 100, 50, 20, 20, 20] * d)], "file string, bytes bigint")
    size = {r["file"]: r["bytes"] for r in files.collect()}
    bins = {}
    for r in C.plan_bins(files, 100).collect():
        assert f"event_date={r['day']}/" in r["file"] and size[r["file"]] < 50
        bins.setdefault((r["day"], r["bin"]), []).append(size[r["file"]])
    assert all(len(b) > 1 and sum(b) < 150 for b in bins.values())
    inner = sorted(bins)[1:-1]
    assert sum(sum(bins[b]) >= 50 for b in inner) >= len(inner) - 3  # but for the last bin of each day
    assert C.plan_bins(files.limit(0), 100).count() == 0


def test_failed_and_concurrent_runs_change_nothing(spark, store, monkeypatch):
    before = _rows(read_events(spark, store))
    real = C._publish

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "_publish", broken)
    with pytest.raises(RuntimeError):
        C.compact(spark, store)
    assert _rows(read_events(spark, store)) == before and C.version(spark, store) == 0

    def late(spark_, store_, number, files):  # another run publishes first
        monkeypatch.setattr(C, "_publish", real)
        C.compact(spark_, store_)
        real(spark_, store_, number, files)

    monkeypatch.setattr(C, "_publish", late)
    with pytest.raises(C.CompactionConflict):
        C.compact(spark, store)
    assert _rows(read_events(spark, store)) == before and C.version(spark, store) == 1
    assert len(read_events(spark, store).inputFiles()) == len({r[0] for r in before})


def test_search_sidecar_after_compaction(spark, store):
    S.update_search_index(spark, store)
    rows = lambda df: [tuple(r) for r in df.collect()]
    want = rows(S.search_store(spark, store, "disk 29", 1000))
    C.compact(spark, store)
    assert rows(S.search_store(spark, store, "disk 29", 1000)) == want and len(want) > 3
    S.update_search_index(spark, store)
    assert rows(S.search_store(spark, store, "disk 29", 1000)) == want
    assert S.candidate_files(spark, store, "no such text") == []

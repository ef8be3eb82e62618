"""The trigram sidecar: same rows as a full scan, from fewer files."""
import pytest
from pyspark.sql import functions as F

from logcase.operators.queries import search
from logcase.schema import EVENTS_SCHEMA
from logcase.sources import search_index as S
from logcase.sources.store import read_events, write_events


def _events(spark, first, n=400):
    e = spark.range(first, first + n)
    k = F.col("id")
    word = F.element_at(F.array(*map(F.lit, ("Disk full on ñandú", "timeout 100%_a", "Überlauf Kelvin", "ok"))), (k / 100).cast("int") % 4 + 1)
    values = {"ts": F.timestamp_seconds(1_700_000_000 + k), "service": F.lit("s"), "level": F.lit("info"), "msg": F.when(k % 50 != 7, word),
              "raw": F.concat(F.lit('{"n":"'), F.md5(k.cast("string")), F.lit('"}')), "file": F.lit("f"), "line": k}
    rows = e.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS_SCHEMA])
    return rows.repartitionByRange(8, "ts")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed") / "my store")
    write_events(_events(spark, 0), path)
    S.update_search_index(spark, path)
    return path


MD5_OF_7 = "8f14e45fceea167a5a36dedd4bea2543"
PATTERNS = ["disk FULL", "full%ñandú", "ñandú", "tim__ut 100", "kelvin", "Kelvin", "über", "ok", "o_", "", "%", MD5_OF_7, MD5_OF_7[:9].upper(),
            "no such text", 'n":"', "full on timeout", "a\\b"]


@pytest.mark.parametrize("mode", ["like", "literal"])
def test_same_rows_as_a_full_scan(spark, store, mode):
    for p in PATTERNS:
        rows = lambda df: [tuple(r) for r in df.collect()]
        assert rows(S.search_store(spark, store, p, 1000, mode)) == rows(search(read_events(spark, store), p, 1000, mode)), p


def test_files_are_ruled_out(spark, store):
    n = {p: len(S.candidate_files(spark, store, p)) for p in (*PATTERNS, "timeout", "ü")}
    files = len(read_events(spark, store).inputFiles())
    assert files == 8 and n[""] == n["ü"] == n['n":"'] == files and n["ñandú"] <= 3
    assert n["no such text"] == 0 and n[MD5_OF_7] == 1 and n["timeout"] <= 3 and n["full on timeout"] <= 1


def test_new_files_are_found_before_and_after_an_update(spark, store):
    write_events(_events(spark, 4000, 100), store)
    counts = []
    for _ in range(3):  # not known, known, known twice over
        counts.append(S.search_store(spark, store, "DISK", 1000).count())
        n = len(S.candidate_files(spark, store, "no such text"))
        S.update_search_index(spark, store)
    assert counts[0] == counts[1] == counts[2] > 100 and n == 0
    assert S._read_index(spark, store).where("at = 0").count() == len(read_events(spark, store).inputFiles())

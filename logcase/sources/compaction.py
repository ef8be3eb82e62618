"""Compaction of an events store: many small files of a day become few of a chosen size.

``compact`` packs the small files of each day into bins by a running sum of their sizes, rewrites each bin as one file,
sorted by (service, ts), under ``<store>/_compacted/run=<id>`` (which a plain listing of the store does not show), and
then publishes a snapshot: a Parquet list of the files that are replaced and of those added, named by a version file that
appears under ``<store>/_snapshots`` by one rename that fails if the version exists. A reader takes the listed files of
the store, without the replaced ones, and the added ones; files appended meanwhile are simply listed. Nothing is deleted
before ``remove_replaced``, so a reader that began before keeps its files.

A run that fails before the rename leaves files that no snapshot names; run again, it starts anew. Of two runs at a time
one publishes and the other raises ``CompactionConflict`` and changes nothing.

Defined results: the rows of the store, repeated ones included, are the same before and after. A bin holds files whose
sizes begin within one ``target_bytes`` of the day's running sum, so at most 1.5 times that much, as only files below half
the target are packed. A bin of one file is left alone, and so is a store without small files, or an empty one. The
columns are those that the store's reader finds when it is first compacted.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logcase.plans.sizing import broadcast_if_small, materialize
from logcase.sources.caps import running_total
from logcase.sources.discover import as_literal, normalise_path

TARGET_BYTES = 512 << 20
_FILES = "file string, live boolean"


class CompactionConflict(Exception):
    """Another compaction was published in the meantime; this one changed nothing."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sub(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def version(spark: SparkSession, store: str) -> int:
    """The number of the last snapshot; 0 if there is none."""
    folder = _path(spark, _sub(store, "_snapshots"))
    fs = _fs(spark, store)
    if not fs.exists(folder):
        return 0
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return max((int(n[1:]) for n in names if n.startswith("v")), default=0)


def _version_file(store: str, number: int) -> str:
    return _sub(store, f"_snapshots/v{number:010}")


def _lines(spark: SparkSession, store: str, number: int) -> list[str]:
    """What a version file holds: the name of its list of files, and the store's schema as JSON."""
    return [r[0] for r in spark.read.text(as_literal(_version_file(store, number))).collect()]


def _schema(spark: SparkSession, store: str) -> StructType:
    """From the last snapshot, as all listed files may be gone; else as a plain read finds it."""
    number = version(spark, store)
    return StructType.fromJson(json.loads(_lines(spark, store, number)[1])) if number else spark.read.parquet(as_literal(store)).schema


def _snapshot(spark: SparkSession, store: str, number: int) -> DataFrame:
    """(file, live) of a snapshot: files added are live, files replaced are not."""
    if not number:
        return spark.createDataFrame([], _FILES)
    name = _lines(spark, store, number)[0]
    return spark.read.schema(_FILES).parquet(as_literal(_sub(store, f"_snapshots/{name}")))


def _publish(spark: SparkSession, store: str, number: int, files: DataFrame) -> None:
    """Writes the list of files, then makes it version ``number`` by a rename that never replaces a file."""
    name = f"files-{uuid.uuid4().hex}"
    schema = _schema(spark, store).json()
    files.write.parquet(_sub(store, f"_snapshots/{name}"))
    jvm = spark.sparkContext._jvm
    part = _path(spark, _sub(store, f"_snapshots/.{name}.tmp"))
    out = _fs(spark, store).create(part, False)
    out.write(bytearray(f"{name}\n{schema}\n".encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        if part.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(part, _path(spark, _version_file(store, number)), spark.sparkContext._gateway.new_array(option, 0))
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        raise CompactionConflict(f"version {number} of {store} exists") from e


def _listed(spark: SparkSession, store: str) -> DataFrame:
    """(file, bytes) of every data file that a plain listing of the store shows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(as_literal(store))
    return found.select(normalise_path(F.col("path")).alias("file"), F.col("length").alias("bytes"))


def _compacted(spark: SparkSession, store: str) -> DataFrame:
    """(file, bytes) of the files of all compactions, published or not."""
    root = _sub(store, "_compacted")
    if not _fs(spark, store).exists(_path(spark, root)):
        return spark.createDataFrame([], "file string, bytes bigint")
    return _listed(spark, root)


def live_files(spark: SparkSession, store: str) -> DataFrame:
    """(file, bytes) of the files that make up the store now."""
    snapshot = _snapshot(spark, store, version(spark, store))
    kept = _listed(spark, store).join(snapshot.where("not live").select("file"), "file", "left_anti")
    return kept.unionByName(_compacted(spark, store).join(snapshot.where("live").select("file"), "file", "left_semi"))


def split_roots(store: str, files: list[str]) -> list[tuple[str, list[str]]]:
    """(base folder, files) of the files of the store itself and of its compactions, where there are any."""
    mark = "/_compacted/run="
    groups = ((store, [f for f in files if mark not in f]), (_sub(store, "_compacted"), [f for f in files if mark in f]))
    return [(base, names) for base, names in groups if names]


def read_files(spark: SparkSession, store: str, files: list[str]) -> list[DataFrame]:
    """Events of the given files, one frame for each base folder; all with the store's columns."""
    schema = _schema(spark, store)
    return [spark.read.option("basePath", base).schema(schema).parquet(*map(as_literal, names)).select(*schema.names)
            for base, names in split_roots(store, files)]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The store as its last snapshot and the files appended since make it."""
    if not version(spark, store):
        return spark.read.parquet(as_literal(store))
    # the driver's file index holds the names anyway
    frames = read_files(spark, store, sorted(r["file"] for r in live_files(spark, store).select("file").collect()))
    if not frames:
        return spark.createDataFrame([], _schema(spark, store))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def plan_bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """(file, day, bin) of the files to rewrite: those below half the target that share a bin with another."""
    day = F.regexp_extract("file", "/event_date=([^/]+)/", 1)
    small = files.where(F.col("bytes") * 2 < target_bytes).withColumn("day", day)
    summed = running_total(small, F.struct("day", "file"), "bytes", "total")
    binned = summed.select("file", "day", F.floor((F.col("total") - F.col("bytes")) / target_bytes).cast("bigint").alias("bin"))
    shared = binned.groupBy("day", "bin").agg(F.count("*").alias("n")).where("n > 1").select("day", "bin")
    return binned.join(shared, ["day", "bin"], "left_semi").select("file", "day", "bin")


def compact(spark: SparkSession, store: str, target_bytes: int = TARGET_BYTES) -> int:
    """Packs the store's small files; returns the number of files written (0 if nothing was to be packed)."""
    number = version(spark, store)
    chosen = materialize(plan_bins(live_files(spark, store), target_bytes), "compaction")
    names = sorted(r["file"] for r in chosen.select("file").collect())  # part of the driver's file index
    if not names:
        return 0
    run = _sub(store, f"_compacted/run=r{uuid.uuid4().hex}")
    bins = broadcast_if_small(chosen.select("file", "bin"), 1_000_000)
    parts = [frame.withColumn("file_name", normalise_path(F.col("_metadata.file_path"), encoded=True)) for frame in read_files(spark, store, names)]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.join(bins.withColumnRenamed("file", "file_name"), "file_name").drop("file_name")
    # one task holds whole bins, each at most one and a half targets large, and writes one file for each
    (rows.repartition("bin", "event_date").sortWithinPartitions("bin", "event_date", "service", "ts").write.partitionBy("bin", "event_date")
         .option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.enabled#request_id", "true").parquet(run))
    written = materialize(_listed(spark, run), "compacted")
    old = _snapshot(spark, store, number)
    gone = chosen.select("file")
    # of earlier snapshots stay the live files not packed now, and the replaced files that are still there
    alive = old.where("live").join(gone, "file", "left_anti")
    replaced = old.where("not live").join(_listed(spark, store), "file", "left_semi")
    files = alive.unionByName(replaced).unionByName(gone.select("file", F.lit(False).alias("live"))).unionByName(
        written.select("file", F.lit(True).alias("live")))
    _publish(spark, store, number + 1, files)
    return written.count()


def remove_replaced(spark: SparkSession, store: str) -> int:
    """Deletes the files that the last snapshot replaced, and returns their number. Readers that began before it must be
    done; repeated or broken off and run again it does no harm."""
    gone = _snapshot(spark, store, version(spark, store)).where("not live").select("file")
    there = _listed(spark, store).unionByName(_compacted(spark, store)).join(gone, "file", "left_semi")
    fs, n = _fs(spark, store), 0
    for row in there.toLocalIterator():
        n += fs.delete(_path(spark, row["file"]), False)
    return n

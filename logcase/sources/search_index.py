"""Trigram sidecar of an events store: which files can hold a search pattern (Q3/F2).

For each file of the store a Bloom filter of the trigrams of its lower-cased messages and raw texts (of ASCII characters
alone) is kept under ``<store>/_search``, in the long form (word number, word, file) sorted by word number: a pattern
looks at a few of the filter's words only, so a search reads some thousandths of the sidecar, pushed down to Parquet,
and then the files that are left. Wildcards cut a pattern into runs; every trigram of a run must be in the file. The
sidecar never decides more than that: files it does not know are read, false positives are read, and the rows come from
the same predicate as without it. Files of a store are never rewritten in place (compaction writes new ones), so an entry stays right;
``update_search_index`` adds what is new, and repeating it, also after a failure, changes no result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.operators.queries import search
from logcase.sources.compaction import read_files
from logcase.sources.discover import as_literal, normalise_path
from logcase.sources.store import read_events

BITS = 18
_FACTORS = (0x9E3779B1, 0x85EBCA77)
_WORDS = 1 << (BITS - 6)


def _index_path(store: str) -> str:
    return f"{store.rstrip('/')}/_search"


def positions(codes: np.ndarray) -> np.ndarray:
    """Places in the filter of trigrams given as 21-bit numbers."""
    return np.concatenate([((codes.astype(np.uint64) * np.uint64(f)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS) for f in _FACTORS])


def trigrams(text: bytes) -> np.ndarray:
    """The distinct trigrams of ASCII characters."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    ascii3 = (b[:-2] < 128) & (b[1:-1] < 128) & (b[2:] < 128)
    seen = np.zeros(1 << 21, bool)
    seen[((b[:-2] << 14) | (b[1:-1] << 7) | b[2:])[ascii3]] = True
    return np.flatnonzero(seen).astype(np.uint32)


def certain_positions(pattern: str, mode: str = "like") -> dict[int, int]:
    """Word number -> bits that a file must have to hold the pattern; empty if the pattern says nothing."""
    runs = [pattern] if mode == "literal" else re.split("[%_]", pattern)
    out: dict[int, int] = {}
    for run in runs:
        for part in re.findall(r"[\x00-\x7f]+", run):
            for p in positions(trigrams(part.lower().encode())).tolist():
                out[p >> 6] = out.get(p >> 6, 0) | 1 << (p & 63)
    return out


def _filters(events: DataFrame) -> DataFrame:
    """(at, word, file) of every file that ``events`` reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[start]:
                    bits = words.setdefault(names[start], np.zeros(_WORDS, np.uint64))
                    p = positions(trigrams(b"\n".join(texts[start:k])))
                    np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
                    start = k
        for name, bits in words.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_WORDS, dtype=np.int32)), pa.array(bits.view(np.int64)), pa.array([name] * _WORDS)],
                                             ["at", "word", "file"])

    text = F.lower(F.concat_ws("\n", "msg", "raw")).cast("binary")
    found = events.select(normalise_path(F.col("_metadata.file_path"), encoded=True).alias("file"), text.alias("body"))
    return found.mapInArrow(run, "at int, word bigint, file string").groupBy("at", "file").agg(F.bit_or("word").alias("word")).where(
        (F.col("word") != 0) | (F.col("at") == 0))  # word 0 stands for the file itself


def _files(spark: SparkSession, store: str) -> DataFrame:
    names = sorted(read_events(spark, store).inputFiles())  # the driver's file index holds them anyway
    return spark.createDataFrame([(n,) for n in names], "file string").select(normalise_path(F.col("file"), encoded=True).alias("file"))


def _read_index(spark: SparkSession, store: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_index_path(store))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "at int, word bigint, file string")
    return spark.read.schema("at int, word bigint, file string").parquet(as_literal(_index_path(store)))


def _events_of(spark: SparkSession, store: str, files: list[str]) -> DataFrame:
    if not files:
        return read_events(spark, store).limit(0)
    return reduce(DataFrame.unionByName, read_files(spark, store, files))


def update_search_index(spark: SparkSession, store: str) -> None:
    """Adds the files that the sidecar does not know yet."""
    known = _read_index(spark, store).where("at = 0").select("file")
    new = [r["file"] for r in _files(spark, store).join(known, "file", "left_anti").collect()]
    if new:
        found = reduce(DataFrame.unionByName, map(_filters, read_files(spark, store, new)))
        found.repartitionByRange("at").sortWithinPartitions("at", "file").write.mode("append").parquet(_index_path(store))


def candidate_files(spark: SparkSession, store: str, pattern: str, mode: str = "like") -> list[str]:
    """The files of the store that the sidecar cannot rule out for ``pattern``."""
    files, wanted = _files(spark, store), certain_positions(pattern, mode)
    if not wanted:
        return [r["file"] for r in files.collect()]
    index = _read_index(spark, store).where(F.col("at").isin(0, *wanted))
    need = F.create_map(*[F.lit(x) for at, bits in wanted.items() for x in (at, bits - (1 << 64) if bits >> 63 else bits)])
    lacking = F.coalesce(need[F.col("at")], F.lit(0).cast("bigint"))
    judged = index.groupBy("at", "file").agg(F.bit_or("word").alias("word")).groupBy("file").agg(
        F.count_if((lacking != 0) & (F.col("word").bitwiseAND(lacking) == lacking)).alias("n"))
    ruled_out = judged.where(F.col("n") < len(wanted)).select("file")
    return [r["file"] for r in files.join(ruled_out, "file", "left_anti").collect()]


def search_store(spark: SparkSession, store: str, pattern: str, limit: int = 10, mode: str = "like") -> DataFrame:
    """``queries.search`` over a store, reading only the files that the sidecar cannot rule out."""
    return search(_events_of(spark, store, candidate_files(spark, store, pattern, mode)), pattern, limit, mode)

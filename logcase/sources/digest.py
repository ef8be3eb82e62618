"""A content digest of files of any size, made from pieces.

A file's lines (unpacked, without line ends) are hashed with their numbers: SHA-256 of ``<number>:<line>``, cut into
eight 32-bit words. Words of the same place are added modulo 2**32, which may be done in any order and over any
pieces, so a file is digested by all tasks that read its splits, and no value holds more than one line. As each line is
hashed with its number, order counts. The digest is the SHA-256 of ``<number of lines>:<the eight sums, comma-joined>``.

Defined results: gzip and plain files of the same lines have equal digests, and so have files that differ in their line
ends or the final one alone; invalid UTF-8 counts as the replacement characters it is read as. An empty file has no
lines and sums of 0. Not meant against forgery: sums of hashes can be collided on purpose, ``with_sha256`` cannot.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.plans.sizing import materialize
from logcase.session import configure, ensure_checkpoint_dir
from logcase.sources.discover import list_files, split_paths
from logcase.sources.lines import number_lines, pin_split_layout, raw_scan, split_stats

WORDS = [f"w{k}" for k in range(8)]
#: Lines of one piece; sums of their words stay far below 64 bits.
PIECE_LINES = 1 << 24


def line_words(line: Column, value: Column) -> list[Column]:
    """The eight words of a numbered line."""
    h = F.sha2(F.concat(line.cast("string"), F.lit(":"), value), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(w) for k, w in enumerate(WORDS)]


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds up partial digests (n_lines and the eight words) by ``keys``."""
    return parts.groupBy(*keys).agg(F.sum("n_lines").alias("n_lines"), *[F.pmod(F.sum(w), F.lit(1 << 32)).alias(w) for w in WORDS])


def partial_digests(lines: DataFrame) -> DataFrame:
    """Partial digests of ``lines`` (file, line, value), per file and piece of its lines."""
    hashed = lines.select("file", F.floor(F.col("line") / PIECE_LINES).alias("piece"), F.lit(1).cast("bigint").alias("n_lines"),
                          *line_words(F.col("line"), F.col("value")))
    return merge(hashed, "file", "piece")


def digest_of(n_lines: Column, words: list[Column]) -> Column:
    return F.sha2(F.concat(n_lines.cast("string"), F.lit(":"), F.concat_ws(",", *[w.cast("string") for w in words])), 256)


def content_digests(spark: SparkSession, paths) -> DataFrame:
    """(path, n_lines, content_digest) of every file that ``ingest`` would read. Two scans, as for line numbers; the first
    one counts alone."""
    configure(spark)
    ensure_checkpoint_dir(spark)
    pin_split_layout(spark)
    src = split_paths(spark, paths, missing="raise")
    raw = raw_scan(spark, src)
    splits = materialize(split_stats(raw).select("src", "file", "bs", "m0", "off"), "digest-splits")
    files = merge(partial_digests(number_lines(raw, splits)), "file").withColumnRenamed("file", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = list_files(spark, src).select("path").join(files, "path", "left").select("path", *map(zero, ("n_lines", *WORDS)))
    return every.select("path", "n_lines", digest_of(F.col("n_lines"), [F.col(w) for w in WORDS]).alias("content_digest"))

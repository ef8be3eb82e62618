"""Read log lines with exact physical line numbers.

Line numbers are computed without moving raw rows:

1. one scan records, per input split (file, block start), its row count and
   the smallest ``monotonically_increasing_id`` of its rows -- the ids of a
   split are consecutive because a split is read in order by one task;
2. a running sum over the (small) split table gives each split's first line;
3. the scan is joined to that table on (file, block start):
   ``line = first_line + (id - min_id) + 1``.

Gzip files are one split each. Blank lines are numbered, then dropped.
Per split the shapes of its first and last non-blank lines are kept too (may
the first open a JSON list or object, is it one complete JSON value, does the
last one end with a closing bracket): they let the document rules decide most
files without reading them whole. Only fixed-width values enter the
aggregate, so it stays a hash aggregate (a string buffer would make Spark sort
every raw line).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logcase.functions.jsonvals import strict_value
from logcase.sources.discover import LOG_GLOB, LogSources, as_literal, normalise_path

NONBLANK = r"(?U)\S"          # Python str.strip() removes Unicode white space
# The line may open a JSON list or object: after the bracket comes what JSON allows there, or nothing.
# (A log line such as "[2026-04-17 02:58:04] ..." or "[main] ..." does not.)
OPENS_LIST = r'^(?U)\s*\[\s*($|[\[{"\]]|(-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity)\s*(,|\]|$))'
OPENS_OBJECT = r'^(?U)\s*\{\s*($|["}])'
CLOSES_LIST, CLOSES_OBJECT = r"(?U)\]\s*$", r"(?U)\}\s*$"


def raw_scan(spark: SparkSession, src: LogSources) -> DataFrame:
    """(src, file, bs, mid, value) for every physical line; nothing may be
    filtered below the id assignment."""
    parts = []
    if src.dirs:
        parts.append((0, spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", LOG_GLOB)
                      .text([as_literal(d) for d in src.dirs])))
    if src.files:
        parts.append((1, spark.read.text([as_literal(f) for f in src.files])))
    if not parts:
        raise ValueError("no log files to read")
    out = None
    for tag, df in parts:
        d = df.select(F.lit(tag).alias("src"), normalise_path(F.col("_metadata.file_path"), encoded=True).alias("file"),
                      F.col("_metadata.file_block_start").alias("bs"),
                      F.monotonically_increasing_id().alias("mid"), "value")
        out = d if out is None else out.unionByName(d)
    return out


def split_stats(raw: DataFrame) -> DataFrame:
    """One row per split: rows, first id, non-blank rows, whether its first
    non-blank line may open a JSON list (``first_open`` 1) or object (2) and is
    one complete JSON value (``first_complete``), whether its last one closes a
    list (``last_close`` 1) or object (2), and the split's first line number
    (``off``). The JSON verdict is only computed for lines that may open one."""
    value = F.col("value")
    nb = value.rlike(NONBLANK)
    opens = F.when(value.rlike(OPENS_OBJECT), 2).when(value.rlike(OPENS_LIST), 1).otherwise(0)
    closes = F.when(value.rlike(CLOSES_OBJECT), 2).when(value.rlike(CLOSES_LIST), 1).otherwise(0)
    complete = F.when(opens > 0, strict_value(value).isNotNull()).otherwise(F.lit(False))
    first = F.when(nb, F.col("mid"))
    st = raw.groupBy("src", "file", "bs").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("mid").alias("m0"),
        F.count_if(nb).alias("nb"),
        F.min_by(opens, first).alias("first_open"),
        F.max_by(closes, first).alias("last_close"),
        F.min_by(complete.cast("int"), first).alias("first_complete"),
    )
    w = Window.partitionBy("src", "file").orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)
    return st.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)))


def pin_split_layout(spark: SparkSession) -> None:
    """Both scans must cut files into the same splits. Spark sizes splits
    from the session's parallelism, which dynamic allocation may change
    between the two jobs; fixing ``spark.sql.files.minPartitionNum`` (only
    when unset) makes the split size depend on the data alone."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def number_lines(raw: DataFrame, stats: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Join the split table (already sized/broadcast by the caller). A split
    the statistics do not know means the file layout changed between the two
    scans: the job fails instead of returning wrong or missing lines."""
    j = raw.join(stats.select("src", "file", "bs", "m0", "off", *extra), ["src", "file", "bs"], "left")
    line = F.when(F.col("m0").isNull(),
                  F.raise_error(F.lit("input splits changed between the statistics and the line scan"))) \
        .otherwise(F.col("off") + (F.col("mid") - F.col("m0")) + 1)
    return j.select("src", "file", line.cast("bigint").alias("line"), "value", *extra)

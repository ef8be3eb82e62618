"""Small helpers that several operators of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase import session

#: White space of the word and line rules: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bounds of the Arrow batches that go to Python workers: long texts make small batches.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def configure(spark: SparkSession) -> SparkSession:
    """The library's session settings and bounded Arrow batches."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return session.configure(spark)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII text (most of it) takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """The maximal runs without white space."""
    return F.regexp_extract_all(c, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(0))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small table, with its size checked before they come to the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows

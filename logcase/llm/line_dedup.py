"""Corpus-wide line deduplication.

Lines are exploded with a 128-bit hash of their normalised form; per hash the distinct documents are counted in a
partial, then a final aggregation, and only the occurrences to drop are joined back. Each document is then rebuilt
from the runs of lines between its dropped positions. Nothing but hashes, ids and positions is shuffled until the
one join that brings a document's dropped positions to its text.

Defined results: a null or empty text is one empty line and never changes. Rows that repeat a ``doc_id`` count as
one document. A null ``doc_id`` is one more document, smaller than all others. An empty table gives an empty table.
Other columns pass unchanged, whatever their names. Text length is unlimited: work per document is linear in its lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import lower_ascii, strip_blanks, text_of

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """Hash of the normalised line; null where the normalised line is too short to count."""
    key = strip_blanks(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(lower_ascii(key).cast("binary"))))


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lines`` (doc_id, key): one row per key found in ``min_docs`` distinct documents or more, with the largest."""
    g = lines.groupBy("key").agg(
        F.count_distinct("doc_id").alias("n"), F.max(F.col("doc_id").isNull().cast("int")).alias("anon"),
        F.max("doc_id").alias("keeper"))
    return g.where(F.col("n") + F.col("anon") >= min_docs).select("key", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``kept`` (the text left), ``n_lines`` and ``n_dropped``."""
    text = text_of(docs)
    body = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("body"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    lines = body.select("doc_id", "version", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).select(
        "doc_id", "version", "pos", line_key(F.col("line"), min_chars).alias("key")).where(F.col("key").isNotNull())
    dropped = lines.join(repeated_lines(lines, min_docs), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("at")).select(
        F.col("doc_id").alias("d"), F.col("version").alias("v"), "at")
    joined = body.join(dropped, F.col("version").eqNullSafe(F.col("v")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    parts = F.split("body", "\n", -1)
    first = F.concat(F.array(F.lit(0)), F.transform("at", lambda p: p + 1))
    last = F.concat(F.col("at"), F.array(F.size("parts")))
    runs = F.transform(F.arrays_zip(first.alias("first"), last.alias("last")),
                       lambda r: F.slice("parts", r["first"] + 1, r["last"] - r["first"]))
    return joined.withColumn("parts", parts).select(
        "row", F.when(F.col("at").isNull(), F.col("body")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("kept"),
        F.size("parts").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_dropped"))


def clean_documents(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text`` and ``n_chars`` (if there) counted anew."""
    out = dedup_lines(docs, **options)
    changed = F.col("n_dropped") > 0
    cols = []
    for c in docs.columns:
        new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema[c].dataType)}.get(c)
        old = F.col("row").getField(c)
        cols.append((F.when(changed, new).otherwise(old) if new is not None else old).alias(c))
    return out.select(*cols)

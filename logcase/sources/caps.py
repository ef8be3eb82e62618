"""Byte and row caps that fall at a certain file.

Files count in path order (by path components, as a sorted listing of paths has them). The byte cap is decided on the
listing alone, before any file is read; the row cap on the split table, before lines are parsed. Both need running
totals, which are made without one task seeing all rows: rows are dealt by ranges of the order, each range is summed,
and only the ranges' sums (one row per range) are added up in one place.

Defined results: a total equal to the cap is allowed, one above it is not; files of no bytes or rows keep the total of
their predecessor; without any file nothing is exceeded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcase.plans.sizing import materialize


class IngestCapExceeded(Exception):
    """A byte or row cap is exceeded: ``path`` is the first file, in path order, at whose end the running ``total``
    lies above ``cap``."""

    def __init__(self, what: str, path: str, total: int, cap: int) -> None:
        super().__init__(f"{what} cap exceeded at {path}: {total} > {cap}")
        self.what, self.path, self.total, self.cap = what, path, total, cap


def path_order(path: Column) -> Column:
    """Sorts paths component by component: ``a/z`` before ``a-b/c``."""
    return F.split(path, "/")


def running_total(df: DataFrame, order: Column, value: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order`` (which should name a row)."""
    dealt = df.withColumn("_order", order).repartitionByRange("_order")
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).select(
        "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per shuffle partition: surely small
    out = dealt.join(F.broadcast(before), "_range").withColumn(total, F.col("_before") + F.sum(value).over(inside))
    return out.drop("_order", "_range", "_before")


def check_cap(what: str, files: DataFrame, value: str, cap: int) -> None:
    """Raises ``IngestCapExceeded`` if the running total of ``value`` over ``files`` (path, value) passes ``cap``."""
    totals = running_total(files.select("path", F.coalesce(value, F.lit(0)).alias(value)), path_order(F.col("path")), value, "total")
    first = totals.where(F.col("total") > cap).agg(F.min_by(F.struct("path", "total"), F.struct("total", path_order(F.col("path"))))).first()[0]
    if first is not None:
        raise IngestCapExceeded(what, first["path"], first["total"], cap)


def rows_per_file(splits: DataFrame, items: DataFrame | None, nonblank: str) -> DataFrame:
    """(path, rows): non-blank lines of the files read by line, from the split table, and the items of documents."""
    found = splits.where("mode <> 'unwrapped'").groupBy(F.col("file").alias("path")).agg(F.sum("nb").alias("rows"))
    if items is None:
        return found
    return found.unionByName(items.groupBy(F.col("file").alias("path")).agg(F.count_if(F.col("value").rlike(nonblank)).alias("rows")))

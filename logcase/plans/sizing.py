"""Size guards for broadcasts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcase.session import scratch_dir

#: Estimated bytes of a scan dealt to one task by ``spread``; Parquet unpacks to several times that.
EVEN_BYTES = 2 << 20


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Counts through a limit,
    so a large input stops early instead of being counted in full."""
    return df.limit(max_rows + 1).count() <= max_rows


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (no job runs). Without
    cost-based statistics filters do not shrink it, so it errs high."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_rows: int, max_estimated_bytes: int = 1 << 30) -> DataFrame:
    """Mark ``df`` for broadcast only when its row count is proven to be at
    most ``max_rows``; otherwise leave the join strategy to Catalyst/AQE
    (which may still broadcast at run time from measured shuffle sizes).
    The proof is a ``limit(max_rows + 1).count()`` job; it is skipped when the
    plan's size estimate already exceeds ``max_estimated_bytes``, so an
    obviously large side costs no extra pass."""
    if max_rows <= 0 or estimated_bytes(df) > max_estimated_bytes:
        return df
    if row_count_at_most(df, max_rows):
        return F.broadcast(df)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts lineage in one job (``checkpoint()`` would compute an
    uncached plan twice) and survives executor loss."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def even_tasks(df: DataFrame) -> int:
    """Into how many tasks to deal ``df`` (a scan) before CPU-heavy work: one per core, and more the larger it is."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // EVEN_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan before CPU-heavy work. Its own partitions say nothing about where the rows are: a Parquet
    file is cut by bytes, but all rows of a row group go to one task and the other tasks get none. Deal the rows of
    the table, before lines or documents are built from them: they are narrower."""
    return df.repartition(even_tasks(df))

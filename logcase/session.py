"""Session settings every logcase function relies on.

* ``spark.sql.session.timeZone=UTC``: naive timestamps in logs mean UTC, and
  the ``events.ts`` column is always read as UTC wall-clock time.
* ``spark.sql.variant.allowDuplicateKeys=true``: a JSON object with a repeated
  key keeps the last value (Python ``json.loads`` behaviour) instead of failing.
"""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings above on an existing session (idempotent)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app_name: str = "logcase",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off. ``extra``
    overrides any default (e.g. to keep site-wide ``extraJavaOptions``)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The parse stage generates one large method per row loop; HotSpot does
        # not JIT methods above 8000 bytes unless told to (≈20% faster parse).
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        **RUNTIME_CONF,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    return configure(spark)


#: Scratch folders made inside the innermost ``scratch_scope``, if there is one.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def runs_in_one_process(spark: SparkSession) -> bool:
    """A plain local master, whose executor shares the driver's folders."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local master gets a temporary one when none is set: on a cluster every
    executor would write to its own disk, so that raises."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base and not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    if not base:
        if not runs_in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logcase-ckpt-"))
        base = sc.getCheckpointDir()
    return base


def scratch_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's checkpoint
    dir). Only when neither is set -- local runs and tests -- a temporary folder
    is created and registered as the checkpoint dir.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/logcase-{name}-{uuid.uuid4().hex[:12]}"
    made = _scope.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the scratch folders made inside it, for work that repeats for ever (stream batches). What
    was read from them must be finished by then."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


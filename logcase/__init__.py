"""logcase: incident-log analytics on Spark.

Ingest line logs and platform exports into one normalised, redacted ``events``
table, ask the five first questions of an investigation as DataFrame functions,
and validate and grade incident case files in batch.
"""
import sys

from pyspark import cloudpickle

from logcase.session import configure, get_session, scratch_dir

__all__ = ["configure", "get_session", "scratch_dir"]

# Functions that run inside tasks travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

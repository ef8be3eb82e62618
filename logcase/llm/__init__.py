"""Training-data operators: cleaning, deduplication, decontamination, scoring and encoding of documents.

Each module holds one operator with its own interface; ``registered`` holds the thin queries over the test tables.
Functions that run inside tasks travel by value, so executors need no copy of this package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

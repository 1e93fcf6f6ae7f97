"""Batch document retrieval, grounding and retrieval evaluation on PySpark."""

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(__import__(__name__))

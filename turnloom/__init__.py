"""Chat-corpus preparation and distillation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from turnloom.config import BatchSpec, Budget, PrepConfig

# Send our Arrow functions to the executors by value, so the package needs no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BatchSpec", "Budget", "PrepConfig"]

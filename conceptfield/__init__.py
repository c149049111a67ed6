"""Semantic-map analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Kernels travel to executors by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics for point clouds and the graphs built over them.

The package's functions travel to the executors by value, so the cluster needs no copy of
the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

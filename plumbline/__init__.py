"""Detection-score analytics and training-data operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

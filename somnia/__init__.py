"""Epoch-based time-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

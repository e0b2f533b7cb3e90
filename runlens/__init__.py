"""Spark-native performance analytics over continuous-integration history."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks are shipped by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

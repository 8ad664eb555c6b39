"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage go to executors by value, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

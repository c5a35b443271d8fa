"""Granary: a PySpark-native analytics library (DataFrame in, DataFrame out)."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Spark-native analytics over a collection of described media items.

Operators take DataFrames and return DataFrames.  Nothing is collected to the
driver except counts that decide a plan (see ``scale``).
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the task itself, so
# the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

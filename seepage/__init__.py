"""Spatial leakage analytics on Spark.

Functions of this package travel to Python tasks by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

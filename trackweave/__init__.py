"""Trackweave: multi-zoom track-density rasters, and the data operations around them, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

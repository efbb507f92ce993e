"""Localisation data work on corpora of drawn or scanned pages, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel by value, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

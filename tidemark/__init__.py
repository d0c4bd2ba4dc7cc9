"""Timed-transcript analytics on Spark DataFrames.

Functions of this package run inside Python tasks too; they are pickled by
value, so that executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

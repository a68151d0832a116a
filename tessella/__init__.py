"""tessella: annotation and prediction analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a session
# works whether or not the package is installed on the worker machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Reading-history analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions by value, so that they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

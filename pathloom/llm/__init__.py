"""Operators for preparing training corpora; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

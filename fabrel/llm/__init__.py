"""Training-data operators: deduplication, filtering, search, mixing and sharding."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Vector-identity analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

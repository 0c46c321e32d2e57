"""Lantern: evidence retrieval and corpus processing as Spark logical plans.

Python functions that run on executors are serialised by value, so workers
need no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

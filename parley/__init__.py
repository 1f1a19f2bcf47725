"""Analytics over chat-completion and embedding traffic, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

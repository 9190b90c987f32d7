"""Spark-first analytics for supply-chain threat intelligence."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's code with the task, so executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

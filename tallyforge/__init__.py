"""Spark-native statistical analytics engine.

Worker-side functions are pickled by value, so that executors need no copy of
this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

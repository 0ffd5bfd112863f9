"""codeweft: code-graph analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

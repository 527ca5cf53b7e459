"""skyfix: Spark-native visual map-matching analytics."""

import sys

from pyspark import cloudpickle

#: Functions sent to Python workers carry this code with them, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A Spark-native engine for collections of long documents and multi-label predictions on them."""

import sys

from pyspark import cloudpickle

# Functions that go to Python workers take their code along: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

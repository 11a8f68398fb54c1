"""Preparation of trace texts as training data: deduplication, filtering, scoring, mixing, packing, sharding."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

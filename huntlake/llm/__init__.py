"""Operators for training-data pipelines: text deduplication, filtering, sanitising, tokenising, mixing."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code along, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

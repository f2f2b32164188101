"""Operators of a training-data pipeline over documents, pages and vectors."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with the job that uses them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

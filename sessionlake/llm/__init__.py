"""Operators of a training-data pipeline. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors
# need no copy of this folder on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

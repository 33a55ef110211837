"""Tabular machine learning as Spark jobs: clean, profile, split, encode, fit, rank, score."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

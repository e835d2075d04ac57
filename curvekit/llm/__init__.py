"""Operators of a training-data pipeline: one module for each, their queries in `queries`."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

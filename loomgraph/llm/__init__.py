"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get the code itself, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

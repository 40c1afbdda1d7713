"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

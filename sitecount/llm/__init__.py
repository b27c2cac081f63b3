"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole: the executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""PySpark-native per-site counting over sequencing alignments."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What runs on executors travels whole: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

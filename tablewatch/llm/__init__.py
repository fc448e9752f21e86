"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: task code travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

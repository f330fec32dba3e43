"""Operators for training-data pipelines. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Lodestone: a data-mining and analytics engine on PySpark DataFrames.

Functions of this package that run in Python workers are pickled by value, so the
workers of a cluster need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions that run in Python workers are sent by value, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

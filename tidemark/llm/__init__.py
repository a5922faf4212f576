"""Operators for preparing training text; nothing else in the library imports this package."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions for executors travel by value: executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Operators for preparing training text.  Nothing else in the library imports this package.

Functions sent to Python workers travel by value, so executors need the third-party
libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

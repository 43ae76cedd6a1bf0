"""Operators for large-scale training-data preparation.

Functions of this package that run on executors are sent by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

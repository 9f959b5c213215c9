"""Operators that prepare training text. Nothing else in the library imports this.

Functions of this subpackage travel to the executors by value, so a cluster
needs the libraries they use but no installed copy of this code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

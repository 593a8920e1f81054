"""Operators that prepare training text at scale. Nothing else in the library imports them.

Functions of this package that run in Python workers are sent with their code,
so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Queries over the test tables, one or more per operator, with SQL to check them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

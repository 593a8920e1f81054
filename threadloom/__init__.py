"""threadloom: text-corpus analytics for timestamped posts, written for Spark.

Every operator takes and returns DataFrames (or Columns), so a job built from
them stays one lazy plan until something is written.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code with them, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

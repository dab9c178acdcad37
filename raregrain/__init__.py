"""Feature building, training and scoring for large tables with a rare label."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors
# need neither an installed copy nor a shipped archive.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

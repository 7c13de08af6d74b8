"""Web page extraction, site roll-up and corpus jobs expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""gregale: text matching and enrichment on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

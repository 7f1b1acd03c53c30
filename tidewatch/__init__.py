"""tidewatch: declarative stream specifications compiled to Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

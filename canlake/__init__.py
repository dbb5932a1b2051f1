"""PySpark-native analytics over vehicle-bus recordings: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Executors get the code with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

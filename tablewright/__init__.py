"""tablewright: an analytics workbench written for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, inside the tasks that use them:
# nothing has to be installed or copied on the executors. Broadcast values are plain data.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

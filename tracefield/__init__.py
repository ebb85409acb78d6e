"""Digital-evidence analytics as plain DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# functions used inside tasks travel with the task, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

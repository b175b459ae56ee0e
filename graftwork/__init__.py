"""Checkpoint analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the executors
# need numpy and pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

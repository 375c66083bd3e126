"""Device telemetry and text corpora as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that clusters need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Posting intelligence on Spark: every step is a function on DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few Arrow functions travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

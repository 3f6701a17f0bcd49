"""Ecological monitoring analytics as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

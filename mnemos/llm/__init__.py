"""Operators of a training-data pipeline: counting, search, filtering, deduplication, mixing.

Nothing outside this subpackage imports it. The functions that run inside Spark tasks are pickled
by value, so the package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

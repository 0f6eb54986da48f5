"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are shipped by value, so a worker needs no copy of the package on its
own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Document analytics on Spark: text search, layout, reports and numeric kernels as DataFrame operations.

Functions that run in Python workers are shipped by value, so a worker needs no
copy of this package on its own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

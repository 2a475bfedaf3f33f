"""Operators of a training-data pipeline; their queries are in ``queries``, the SQL in ``oracle``."""

import sys

from pyspark import cloudpickle

# Functions that run in executors' Python workers travel with their code, so that a cluster
# needs no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

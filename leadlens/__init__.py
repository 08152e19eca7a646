"""leadlens: a Spark-native prospect analytics engine.

Every operator is a function from DataFrame(s) to DataFrame, written with the
DataFrame / SQL API so Catalyst plans it and the work runs partitioned.
"""

__version__ = "0.1.0"

# Functions shipped to Python workers (mapInPandas kernels) travel by value, so executors
# need no copy of this package on their path.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

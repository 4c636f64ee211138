"""millwright: machine-telemetry analytics as Spark DataFrame / SQL / ML / Streaming jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python functions shipped to executors (mapInPandas, mapInArrow, applyInPandasWithState)
# are pickled by value, so executors need no installed copy of this package.
from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Many gridded time series on Spark: clean, scale, correlate, window, forecast, score.

Every operator maps DataFrames to DataFrames on one long schema
``(cell_id STRING, t BIGINT, v DOUBLE)``; a missing value is NULL, never NaN, and
``(cell_id, t)`` is unique.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions used in tasks travel with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

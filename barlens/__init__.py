"""barlens: point-in-time intraday bar analytics expressed as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame, so operators
compose with ``df.transform`` and Catalyst sees one plan.
"""

import sys

from pyspark import cloudpickle

from barlens.schema import BAR_COLUMNS, BAR_SCHEMA, SessionSpec, require_columns

__all__ = ["BAR_COLUMNS", "BAR_SCHEMA", "SessionSpec", "require_columns"]

# Functions of this library travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

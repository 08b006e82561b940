"""fleetlens: operational questions over many deployed clusters, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from fleetlens.session import build_session

# Functions of this package travel to executors whole, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]

"""Sensor time series and cruise samples on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from sensorframe.session import build_session

# Functions that run in Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]

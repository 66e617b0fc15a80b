"""Spark-native text-curation analytics: de-identification, near-duplicate decisions and their metrics."""

from pyspark import cloudpickle as _cloudpickle

import shinglemill as _self

# Functions sent to executors travel by value, so a cluster needs no install of this package on its workers.
_cloudpickle.register_pickle_by_value(_self)

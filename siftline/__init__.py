"""siftline: message-safety analytics expressed as Spark DataFrame operators."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers travel with the task, so executors do not
# need this package installed.
import siftline as _self

_cloudpickle.register_pickle_by_value(_self)

__version__ = "0.1.0"

"""Batch and streaming jobs over code-vulnerability samples, written for PySpark."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

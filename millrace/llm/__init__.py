"""Operators for preparing texts that language models learn from."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their jobs, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

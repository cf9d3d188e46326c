"""Operators for preparing training corpora. Functions are sent to the workers by value, so these need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python workers get these functions by value, so the package need not be installed on the cluster's machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Sensitive-text governance on Spark: detect, redact, tokenise, restore, audit, report."""

import sys

from pyspark import cloudpickle

# Python workers get the small helpers of this package with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""colloquy: question-and-answer transcript analytics on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

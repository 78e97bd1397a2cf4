"""Operators that prepare text and vectors for model training."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so a cluster needs no
# installed copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

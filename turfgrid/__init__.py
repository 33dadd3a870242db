"""Pass-surface analytics on Spark: football passes in, pitch rasters and scores out."""

import sys

from pyspark import cloudpickle

from turfgrid.constants import Pitch

# Functions sent to Python workers carry their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Pitch"]

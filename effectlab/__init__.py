"""effectlab: controlled-experiment ledgers analysed as Spark jobs."""

import sys

from pyspark import cloudpickle

from effectlab.schema import Names, Outcome

# Kernels travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Names", "Outcome"]

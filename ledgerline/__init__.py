"""Analytics over agent-run logs and other keyed, ordered data, on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

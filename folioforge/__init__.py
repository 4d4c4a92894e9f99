"""Document analytics on PySpark: a corpus is a DataFrame, an operational log is a table, every step is a plan."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

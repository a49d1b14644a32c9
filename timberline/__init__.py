"""Decision-tree analytics as Spark plans.

Python functions that Spark tasks run are pickled by value, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

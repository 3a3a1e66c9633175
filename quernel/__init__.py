"""quernel: tabular and time-indexed analytics expressed as Spark plans.

Functions of this package that run on executors travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

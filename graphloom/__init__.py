"""graphloom: knowledge-graph queries and data processing on plain PySpark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

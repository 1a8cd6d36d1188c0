"""Program-flow analytics as DataFrame queries on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

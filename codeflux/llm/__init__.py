"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

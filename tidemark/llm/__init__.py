"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; it may be removed as a
whole.  Functions that run in Python workers are pickled by value, so an
executor needs numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

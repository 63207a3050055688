"""Training-data operators and their queries.

What runs inside Python tasks is sent with the job by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

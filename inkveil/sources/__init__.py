"""Where texts come from and where results go."""

import sys

from pyspark import cloudpickle

# readers travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

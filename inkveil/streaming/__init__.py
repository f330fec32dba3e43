"""Streams: scans, bursts, latest findings and the block latch."""

import sys

from pyspark import cloudpickle

# stateful processors travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

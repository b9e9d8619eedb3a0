"""Access-log analytics and anomaly detection on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that nothing has to
# be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

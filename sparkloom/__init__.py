"""sparkloom: DataFrame-in / DataFrame-out analytics operators for PySpark."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

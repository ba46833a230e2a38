"""groundwell: a Spark-native passage store with similarity search and grounded answers.

Every operator takes DataFrames and returns DataFrames. The few functions that run in Python
workers travel to the executors with the job, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Job-offer collection, cleaning, scoring and search as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the few Python functions that run in
# tasks are sent with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

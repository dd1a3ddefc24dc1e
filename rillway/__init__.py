"""Batch ETL operators and document-quality jobs, written on the PySpark DataFrame API."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

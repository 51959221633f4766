"""Tabular data engine on PySpark: strict readers, typed binding, validation, profiling, conversion.

The modules' functions travel to the executors by value, so the executors need no copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

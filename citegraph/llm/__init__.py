"""Operators of a training-data pipeline: one module per operator, queries in `queries`.

Functions of this package that run in Python workers travel with their code, so the executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

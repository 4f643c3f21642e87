"""Operators for training-data pipelines: text, vectors, token files.

Task code of this package is pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

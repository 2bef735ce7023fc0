"""Lexical-stress analytics on Spark: dictionaries, lookup, features, quality.

Functions that run on executors are pickled by value, so executors need no copy
of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

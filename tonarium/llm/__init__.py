"""Operators for training-data pipelines: packing, media columns, exact top-k,
URL filters, line and substring dedup, SimHash, mixing, HTML text, toxicity,
token counts, periodic runs, importance resampling.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline over ``documents``, ``embeddings``, ``labels`` and ``conversations``.

Nothing else in the library imports this subpackage.  Functions that run inside tasks are pickled by value, so that
executors need Spark and numpy but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for large training corpora. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code along, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

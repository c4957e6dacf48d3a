"""Operators that prepare text for training language models.

The functions that run inside tasks travel by value, so executors need numpy,
pyarrow and the libraries named in the modules, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

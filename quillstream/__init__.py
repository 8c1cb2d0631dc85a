"""quillstream: document-corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped by value, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

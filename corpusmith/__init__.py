"""Search and bundling of large text and source collections as Spark jobs.

Everything is a function from DataFrame to DataFrame.  The package is pickled by
value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: archives, extraction, filtering, deduplication, mixing, output and search.

Every operator takes and returns DataFrames; ``queries.py`` binds them to the given tables.
Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# What runs in a task travels with it, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

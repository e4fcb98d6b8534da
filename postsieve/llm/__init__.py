"""Operators for preparing training data: dedup, mixing, scans, classifiers, search, tokens.

Each module holds one operator with its own interface; `queries` applies them to the test tables
and `sql` holds the same results as SQL where SQL can express them. Nothing else in the library
imports this subpackage. Its functions travel to executors by value, so workers need not have the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

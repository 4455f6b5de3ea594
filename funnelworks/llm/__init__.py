"""Corpus operators for language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin queries that apply them to the driver's tables.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""cadenza: a PySpark-native engine for sampled signals held in tables.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (file formats), ``plans`` (composed queries) and
``streaming``.  ``llm`` holds training-data operators; nothing else imports it.

Functions that run in Python workers are pickled by value, so a job needs no
copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

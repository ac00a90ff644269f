"""Lodestone: Spark-native retrieval, trajectory and evaluation analytics.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function over explicit schemas;
Catalyst picks the physical plan.  Functions that run in Python workers are pickled by value, so the
package does not have to be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

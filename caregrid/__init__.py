"""caregrid: health-facility registry analytics on Spark.

Raw registry rows become uniquely keyed Bronze records, a typed capability
record per facility (Silver), trust-scored Gold records, and three bulk read
models: nearest trusted facilities per request, vector + intent ranking per
text query, and coverage gaps ("deserts") per postal area.

Every operator is a ``DataFrame -> DataFrame`` function built from native
Spark SQL expressions; Python runs inside executors only for caller-supplied
embedders/completers and the blocked vector dot product.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from caregrid.config import Params

# Python workers get the functions of this package by value, so they need not be able to import it.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]

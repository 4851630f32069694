"""terrastat: survey and gridded-covariate analytics on Spark DataFrames."""

import os
import sys

# The driver solves small systems only; one BLAS thread leaves the cores to Spark.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark import cloudpickle  # noqa: E402

# Arrow functions travel to executors by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

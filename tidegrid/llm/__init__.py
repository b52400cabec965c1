"""Operations of a large training-data pipeline, one module per operator."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors travel with their code, so that executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

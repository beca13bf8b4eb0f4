"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# the functions travel with the tasks, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

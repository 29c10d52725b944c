"""Entity resolution and directory analytics over creator accounts on Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel to the workers with the code they use, so no worker needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

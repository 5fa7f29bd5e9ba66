"""Search, query and graph analytics over collections of Markdown notes, as Spark plans."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

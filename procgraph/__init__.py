"""procgraph: a Spark-first engine for procedural text, flow graphs and retrieval.

Every operator is a function from DataFrames to a DataFrame.  Python functions
that run on executors are shipped by value, so a cluster needs no copy of this
package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Document screening and matching as Spark jobs.

Layout
------
functions   Column -> Column building blocks, no shuffle, no Python worker
operators   DataFrame -> DataFrame building blocks
sources     readers and writers
plans       the two end-to-end jobs: the offline build and the screening run
streaming   the screening run over arriving documents
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a cluster needs no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Cadenza: DataFrame-native analytics over time-segmented text, event and vector data."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its functions travel with the plans that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""groundline: document retrieval and numeric grounding as PySpark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary

# The few functions that run inside tasks travel with them, so workers need no installed package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT_DICTIONARY", "Dictionary"]

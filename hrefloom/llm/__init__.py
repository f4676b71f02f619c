"""Operators for training corpora.

Functions that run in Python workers are sent whole, so an executor does not
need this package installed.
"""

from pyspark import cloudpickle

import hrefloom

cloudpickle.register_pickle_by_value(hrefloom)

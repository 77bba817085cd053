"""Operators for preparing training text at scale.

Every module holds one operator as a Spark job; ``queries`` registers them.
Task functions of this package travel with the job (pickled by value), so
executors need no installed copy of the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

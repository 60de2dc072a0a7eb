"""Operators for training-data corpora: joins, classifiers, sampling, fingerprints, archives.

Nothing else in the library imports this package. Its functions reach the executors by
value, so the workers need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Send functions of this package to Python workers by value.

Executors then need numpy and pandas, but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value() -> None:
    package = sys.modules[__name__.split(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)

"""Functions that run on the workers without a copy of this package there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send a module's functions to the workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])

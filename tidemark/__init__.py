"""A Spark-native feature engine for OHLCV bars."""

import os
from pathlib import Path

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Where Python workers can't import the package, its functions travel with the tasks."""
    root = Path(__file__).resolve().parent.parent
    known = [*filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)), os.getcwd()]
    if root not in [Path(p).resolve() for p in known]:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()

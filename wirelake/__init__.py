"""A PySpark-native engine for dissected network captures and other wide, sparsely populated event tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"

_shipped: set[str] = set()


def ship(spark) -> None:
    """Make this package importable on the executors (once for each Spark application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Spark sends this file from the driver to the executors; they read nothing of the driver's folders.
    at = os.path.join(tempfile.mkdtemp(prefix="wirelake-ship-"), "wirelake_ship.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)

"""Sends this package to the Python workers of a session, once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Workers can import the package afterwards, wherever they run; returns spark."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        here = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"tessera/{p.relative_to(here).as_posix()}")
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark

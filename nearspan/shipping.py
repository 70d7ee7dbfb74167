"""Sends the package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session; the driver serves the archive, executors need no folder in common."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "nearspan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"nearspan/{f.relative_to(here)}")
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)

"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="pixelfold-")) / "pixelfold.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, f"{top.name}/{source.relative_to(top)}")
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)

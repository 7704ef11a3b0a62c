"""Sends this package to the executors, so that Python workers need no copy of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context, once."""
    sc = spark.sparkContext
    if getattr(sc, "_docsieve_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="docsieve-")) / "docsieve.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"docsieve/{f.relative_to(here)}")
    sc.addPyFile(str(path))
    sc._docsieve_shipped = True

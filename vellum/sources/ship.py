"""The package's own code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    zipped = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum_package.zip"
    with zipfile.ZipFile(zipped, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(zipped))
    sc._vellum_shipped = True

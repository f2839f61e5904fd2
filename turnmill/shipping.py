"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the workers, once for each application.

    Workers on this machine that inherit its path need nothing; all others get
    a zip file through the driver.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    context = spark.sparkContext
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.master.startswith("local") and package.parent in {Path(x).resolve() for x in seen if x}:
        return
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # on the driver only, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))

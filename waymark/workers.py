"""Makes this package importable in Python workers, which may run on other machines."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the workers of a session, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    folder = tempfile.mkdtemp(prefix="waymark-")
    name = os.path.join(folder, "waymark.zip")
    Path(name).write_bytes(held.getvalue())
    context.addPyFile(name)
    _shipped.add(context.applicationId)

"""Making this package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, unless they have its folder on their path."""
    root = str(_PACKAGE.parent)
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="reqloom-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = folder / "reqloom_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)

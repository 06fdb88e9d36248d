"""Gives this package to executors that do not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the whole package to the application's Python files, once; the archive is served until the driver ends."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    package = Path(__file__).resolve().parent
    served = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, served, ignore_errors=True)
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(package, Path(folder, package.name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{served}/{package.name}", "zip", folder))
    _done.add(app)

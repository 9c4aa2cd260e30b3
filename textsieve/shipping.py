"""Puts this package on the workers' path, once for each application."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Call before a Python function of this package runs on executors."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp()) / package.name
        _SHIPPED[app] = shutil.make_archive(str(base), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(_SHIPPED[app])

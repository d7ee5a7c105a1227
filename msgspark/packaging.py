"""Getting the package to the executors of a session that was started without it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to every executor, once per application.

    Spark copies the archive itself. Not needed where the package is installed on the
    nodes or given to ``spark-submit --py-files``.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = Path(folder) / package.name
    shutil.copytree(package, base / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(base), "zip", root_dir=base, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)

"""The package on the executors: their Python workers need it wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Adds the package's modules to the Python path of this application's workers, once."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    # Spark's own file server hands the archive on, so the driver's temporary folder is enough.
    archive = os.path.join(tempfile.mkdtemp(prefix="silovalue-"), "silovalue_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "silovalue")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)

"""What a session needs before plans of this package run: sound unions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_REUSE = "spark.sql.unionOutputPartitioning"


def ship(spark: SparkSession) -> None:
    """Adds the package's source files to the application once, as a zip that executors fetch from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="maskwright-"), "maskwright.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path(here.name) / f.relative_to(here))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def sound_unions(spark: SparkSession) -> None:
    """Turns off the reuse of a union's partitioning by what follows it: with Spark 4.1, windows over such unions lose and repeat rows."""
    if spark.version.startswith("4.") and spark.conf.get(_REUSE, None) != "false":
        spark.conf.set(_REUSE, "false")

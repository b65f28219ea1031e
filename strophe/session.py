"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python, once per application, so that it need not be installed there.

    Where the session doesn't say how many bytes an Arrow batch may hold, 2 MB: rows are whole texts, and 10,000 of them are no bound.
    """
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, "2m")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="strophe-ship-"))
        shutil.copytree(here, to / "src" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(to / here.name), "zip", to / "src"))
        _SHIPPED.add(app)
    return spark

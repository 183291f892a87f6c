"""Session factory, and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "undertow", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        BATCH: BATCH_BYTES,
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: The bytes of one Arrow batch: texts are long, and a task holds a batch several times over on both sides.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors through Spark's own file server, once for each application.

    A session that has Spark's own bound on the bytes of an Arrow batch, 64 MB, gets BATCH_BYTES.
    """
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        folder = os.path.realpath(tempfile.mkdtemp(prefix="undertow-"))  # the driver serves it as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "undertow-package.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(path)
    return spark

"""Sessions, and the package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "marginalia", **conf: str) -> SparkSession:
    """A session with the settings that the plans assume; spark-submit's own settings win where they are set."""
    builder = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(ROOT):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    sc.addPyFile(path)
    sc._marginalia_shipped = True

"""Session settings that the operators expect."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(name: str = "voxtable", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors, where it isn't installed on them: Arrow functions import it there."""
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as scratch:
        made = shutil.make_archive(f"{scratch}/voxtable", "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(made)
    return os.path.basename(made)

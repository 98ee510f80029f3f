"""Sends this package to the executors, for jobs whose Python workers can't import it from their own path."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a Spark context; Spark hands the archive to executors that join later too."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shipped-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = pathlib.Path(folder, "src", here.name)
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(pathlib.Path(folder, here.name)), "zip", copy.parent))
    sc._palimpsest_shipped = True

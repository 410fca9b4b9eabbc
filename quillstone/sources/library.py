"""Brings this package to the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def packed(folder: str, to: str) -> str:
    """A zip file of the package in ``folder``, without caches."""
    name = os.path.basename(folder)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for at, folders, files in os.walk(folder):
            folders[:] = sorted(d for d in folders if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join(name, os.path.relpath(os.path.join(at, f), folder)))
    return to


def ship(spark: SparkSession) -> None:
    """Adds the package to the application once, so that Python workers import it wherever the driver was started.

    Spark serves the file from the driver to every executor, those that come later too; nothing else reads it.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(folder):  # not itself imported from a zip file
            spark.sparkContext.addPyFile(packed(folder, os.path.join(tempfile.mkdtemp(prefix="spark-"), "quillstone.zip")))
        _shipped.add(application)


def shipped(f: Callable) -> Callable:
    """f(spark, ...) after the package was shipped."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return run
